"""Operator 5, language of web pages by Bayesian evidence fusion.

A page's language has a posterior from four kinds of evidence:

* text: character trigrams of the visible text under a model of each language, learnt from the
  labelled documents (at most FIT_ROWS, an expected number, chosen by hash; at most TRIGRAMS of each
  language are kept). Trigrams of a text depend on each other, so their log-likelihood is tempered.
* declared: the page's markup language, by P(declared | language).
* suffix and host: a prior from the host's other pages, smoothed towards its domain's, that towards
  P(language | suffix) of the address, and that towards all pages, with SMOOTHING pseudo-pages at
  each level. The suffix counts once, as the root of its hosts' hierarchy.

The tables are sums of the pages' text posteriors, grouped by declared language, host, domain and
suffix. A page's own posterior is taken out of each of them, so no page confirms itself. Hosts have a
row each, and a host with very many pages only meets them in a join that Spark splits; suffixes meet
domains by broadcast while they are few, which is counted.

Null html or url: no evidence of that kind. Without any, the posterior is the prior over all other
pages. Long and broken pages are read in one pass: an element or comment that isn't closed isn't
hidden. Ties go to the language that is first by name. Repeated rows and null ids: judged like
others. No pages: no rows. No labelled documents: no rows can be judged, so lang is null. Further
columns don't matter.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import met, small_batches, text_of, written

FIT_ROWS, TRIGRAMS, SMOOTHING, TEMPER, MOST_TRIGRAMS = 20_000, 4_000, 5.0, 0.1, 400
OPENED = re.compile(r"<(?:(script|style|nav|template)\b|!--)", re.I | re.A)
CLOSED = {k: re.compile(rf"</{k}\s*>", re.I | re.A) for k in ("script", "style", "nav", "template")} | {"": re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
HTML = re.compile(r"<html\b", re.I | re.A)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)")


def shown(page: str) -> str:
    """Without comments and hidden elements, in one pass: what has no end after one place has none after later ones."""
    out, at, open_ended = [], 0, set()
    found = OPENED.search(page)
    while found:
        kind = (found[1] or "").lower()
        end = None if kind in open_ended else CLOSED[kind].search(page, found.end())
        if end:
            out += [page[at : found.start()], " "]
            at = end.end()
        else:
            open_ended.add(kind)
        found = OPENED.search(page, end.end() if end else found.end())
    return "".join(out) + page[at:]


def visible(page: str) -> str:
    plain = shown(page)
    last = plain.rfind(">") + 1  # no tag ends behind it
    return html_lib.unescape(TAG.sub(" ", plain[:last]) + plain[last:])


def declared(page: str) -> str | None:
    """The markup language of the first html tag that has one."""
    found = HTML.search(page)
    while found:
        end = page.find(">", found.end())
        end = len(page) if end < 0 else end
        if m := LANG.search(page, found.end(), end):
            return m[1].lower()
        found = HTML.search(page, end)
    return None


def trigrams(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
        w = f" {word} "
        for k in range(len(w) - 2):
            out[w[k : k + 3]] += n
    return out


def fit(docs: DataFrame) -> dict[str, dict[str, float]]:
    """For each language, log P of its trigrams; "" is that of an unseen one."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter("lang IS NOT NULL")
    total = known.count()
    if not total:
        return {}
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / total)))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(trigrams(text))
        for lang, c in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "gram": list(c), "n": pa.array(c.values(), pa.int64())})

    counts = written(chosen.select(F.col("lang"), text_of().alias("text")).mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # One job for all languages, however many are labelled.
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept: dict[str, list] = {}
    for r in counts.withColumn("place", first).filter(F.col("place") <= TRIGRAMS).collect():
        kept.setdefault(r["lang"], []).append(r)
    out = {}
    for lang, n in sorted(sums.items()):
        best = kept[lang]
        size = n + 0.5 * (len(best) + 1)
        out[lang] = {r["gram"]: math.log((r["n"] + 0.5) / size) for r in best} | {"": math.log(0.5 / size)}
    return out


def _evidence(pages: DataFrame, model: dict[str, dict[str, float]]) -> DataFrame:
    """page_id, host, domain, suffix, declared, p: the text's posterior under equal priors."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        langs = sorted(model)
        for batch in batches:
            out = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = (m[1].lower().rstrip(".") if (m := HOST.match(url or "")) else None) or None
                parts = host.split(".") if host else []
                grams = trigrams(visible(page or ""))
                weight = TEMPER * min(1.0, MOST_TRIGRAMS / max(1, sum(grams.values())))
                logs = [weight * sum(n * model[x].get(g, model[x][""]) for g, n in grams.items()) for x in langs]
                odds = [math.exp(v - max(logs)) for v in logs]
                out.append((page_id, host, ".".join(parts[-2:]) or None, parts[-1] if parts else None, declared(page or ""), [v / sum(odds) for v in odds]))
            kinds = (pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["page_id", "host", "domain", "suffix", "declared", "p"])

    schema = "page_id long, host string, domain string, suffix string, declared string, p array<double>"
    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, schema), "evidence")


def _each(n: int, of: str, alias: str) -> Column:
    return F.array(*(F.sum(F.col(of)[k]) for k in range(n))).alias(alias)


def _others(sums: Column, own: Column) -> Column:
    """Sums without the page's own share."""
    return F.zip_with(sums, own, lambda x, p: F.greatest(x - p, F.lit(0.0)))


def _smoothed(sums: Column, above: Column) -> Column:
    """(sums + SMOOTHING * above) / (their total + SMOOTHING)"""
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x) + SMOOTHING
    return F.zip_with(sums, above, lambda x, q: (x + SMOOTHING * q) / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang, posterior: one row a page."""
    model = fit(docs)
    if not model:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("declared", "string"), ("text_lang", "string"), ("lang", "string"), ("posterior", "double"))))
    langs = sorted(model)
    n = len(langs)
    rows = _evidence(pages, model)
    whole = F.array(*(F.lit(float(x or 0.0)) for x in rows.agg(_each(n, "p", "s")).head()["s"]))
    # Host, domain and suffix, each from the sums below it.
    hosts = rows.filter("host IS NOT NULL").groupBy("host", "domain", "suffix").agg(_each(n, "p", "hs"))
    domains = hosts.groupBy("domain", "suffix").agg(_each(n, "hs", "ds"))
    suffixes = domains.groupBy("suffix").agg(_each(n, "ds", "ss"))
    priors = hosts.join(met(domains, suffixes, "suffix").select("domain", "ds", "ss"), "domain").select("host", "hs", "ds", "ss")
    # Markup languages have two or three letters, so there are at most 26 ** 2 + 26 ** 3 of them.
    said = rows.filter("declared IS NOT NULL").groupBy("declared").agg(_each(n, "p", "cs"))
    joined = rows.join(priors, "host", "left").join(F.broadcast(said), "declared", "left")
    own, none, one = F.col("p"), F.array_repeat(F.lit(0.0), n), F.array_repeat(F.lit(1.0), n)
    joined = joined.withColumn("rest", _others(whole, own))
    top = F.transform("rest", lambda x: (x + 1) / (F.aggregate("rest", F.lit(0.0), lambda a, y: a + y) + n))
    joined = joined.withColumn("prior", top)
    for sums in ("ss", "ds", "hs"):
        joined = joined.withColumn("prior", F.when(F.col("host").isNotNull(), _smoothed(_others(F.coalesce(sums, none), own), F.col("prior"))).otherwise(F.col("prior")))
    likely = F.when(F.col("cs").isNotNull(), F.zip_with(_others(F.col("cs"), own), F.col("rest"), lambda s, t: (s + 0.1) / (t + 1))).otherwise(one)
    joined = joined.withColumn("dl", likely)
    joined = joined.withColumn("odds", F.array(*(F.col("prior")[k] * F.greatest(own[k], F.lit(1e-12)) * F.col("dl")[k] for k in range(n))))
    names = F.array(*map(F.lit, langs))
    best = lambda a: names[F.array_position(a, F.array_max(a)).cast("int") - 1]
    return joined.select(
        "page_id", "host", "declared", best(F.col("p")).alias("text_lang"), best(F.col("odds")).alias("lang"), (F.array_max("odds") / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)).alias("posterior")
    )
