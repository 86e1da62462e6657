"""Operator 10, quality rules as a learned decision list, in DataFrame functions only.

Each document gets statistics of its whole text. Sequential covering learns, from labelled
statistics (quality 0 or 1), an ordered list of rules that reject: a rule is a conjunction of
thresholds, grown on two thirds of the rows by information gain, pruned on the other third, and
accepted while it is right there in at least RIGHT_PERCENT % of its cases; the rows that it covers
leave, and the next rule is learnt. Thresholds are quantiles. All counts are grouped sums in Spark;
the driver sees a row for each statistic and quantile. At most FIT_ROWS labelled rows (an expected
number; chosen by hash) are learnt from. The list is emitted as one ordered CASE expression.

A document is also rejected by the base rule: fewer than 50 words, or more than half of its words
in repeated 3-word windows. Null text: no words, rejected. Null ids: judged, never learnt from.
Repeated rows are judged each; of contradicting labels of an id the lower one holds. Long texts are
judged whole: windows are kept as 64-bit hashes with their places, sorted. Ties: of equal gains the
statistic listed first, then the lower threshold. No rows: none. No labels: the base rule alone.
Columns of the table that have a count's name don't matter to quality_rules(), and with_counts()
replaces them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_of, written

FIT_ROWS, QUANTILES, MAX_RULES, MAX_TERMS, RIGHT_PERCENT, LEAST_CASES = 40_000, 24, 8, 3, 95, 8
WHITE = r"[\x20\x09-\x0D]+"

#: Statistics that rules may test, as SQL over the counts. None of them grows or falls with a text's length.
STATISTICS = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]


@dataclass(frozen=True)
class Term:
    statistic: str
    above: bool  # at least the threshold, else less than it
    threshold: float

    def sql(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold!r}D"


Rule = tuple[Term, ...]


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with COUNTS. Names of docs that clash with them are replaced."""
    out = docs.withColumn("_text", text_of()).withColumn("_words", F.array_remove(F.split("_text", WHITE), ""))
    out = out.withColumn("_joined", F.array_join("_words", "")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    # Hashes of 3-word windows; if one occurs twice, each is paired with its place and sorted, so equal ones are neighbours.
    out = out.withColumn("_n", n).withColumn(
        "_windows",
        F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    out = out.withColumn(
        "_places",
        F.transform(F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j - 1)) | same(x, F.get("_sorted", j + 1))), lambda x: x["i"]),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("_places", lambda p: F.array(p, p + 1, p + 2)))))
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length("_joined"),
        "n_symbols": F.length("_text") - _without(F.col("_text"), r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_places").isNull(), 0).otherwise(covered),
        "n_lines": F.size("_lines"),
        "n_upper": F.length("_joined") - _without(F.col("_joined"), r"\p{Lu}"),
        "n_digits": F.length("_joined") - _without(F.col("_joined"), r"[0-9]"),
        "n_marks": F.length("_joined") - _without(F.col("_joined"), r"[!?;:=~^_{}\[\]/\\]"),
    }
    kept = [c for c in docs.columns if c not in counts]
    # Always 0. As it isn't deterministic, filters over counts stay above, where they can't put the
    # making of an array into a function that runs for each of its elements.
    zero = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    return out.select(*kept, *((c.cast("long") + zero).alias(name) for name, c in counts.items()))


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def with_statistics(counted: DataFrame) -> DataFrame:
    """STATISTICS in place of COUNTS, without the other columns but doc_id."""
    return counted.select("doc_id", *(F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()))


def sampled(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one row an id, an expected FIT_ROWS at most."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))


def learn(counted: DataFrame, chosen: DataFrame) -> list[Rule]:
    """The decision list. counted: doc_id and COUNTS; chosen: sampled() labels, few enough to broadcast."""
    rows = with_statistics(counted).join(F.broadcast(chosen), "doc_id").withColumn("prune", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0)
    names = list(STATISTICS)
    rows = written(rows.select("quality", "prune", *names), "labelled")
    steps = [k / QUANTILES for k in range(1, QUANTILES)]
    tail = [0.9 + k / 100 for k in range(1, 10)]
    parts = rows.groupBy((F.col("quality") == 0).alias("bad")).agg(*(F.percentile_approx(c, [*steps, *tail], 5000).alias(c) for c in names)).collect()
    cuts = {c: sorted({x for r in parts for x in r[c] or () if x is not None}) for c in names}
    # Each row's place among the cuts of each statistic; rules are then comparisons of small numbers.
    binned = written(rows.select((F.col("quality") == 0).alias("bad"), "prune", F.array(*(_place(F.col(c), cuts[c]) for c in names)).alias("bins")), "binned")
    dropped(rows)
    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < MAX_RULES:
        left = binned.filter(" AND ".join(f"NOT ({_on_bins(r)})" for r in rules) or "true")
        rule = _grow(left.filter("NOT prune"), names, cuts)
        best, right = _prune(left.filter("prune"), rule)
        if not best or right < RIGHT_PERCENT:
            break
        rules.append(best)
    dropped(binned)
    return [tuple(Term(names[f], above, cuts[names[f]][at]) for f, above, at in r) for r in rules]


def _place(value: Column, cuts: list[float]) -> Column:
    """How many cuts the value reaches."""
    return F.aggregate(F.array(*map(F.lit, cuts)).cast("array<double>"), F.lit(0), lambda n, c: n + F.when(value >= c, 1).otherwise(0)) if cuts else F.lit(0)


def _on_bins(rule: list[tuple[int, bool, int]]) -> str:
    return " AND ".join(f"bins[{f}] {'>' if above else '<='} {at}" for f, above, at in rule) or "true"


def _grow(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> list[tuple[int, bool, int]]:
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < MAX_TERMS:
        counted = rows.filter(_on_bins(rule)).select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counted:
            table.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
        if not table:
            break
        p0, n0 = (sum(x[k] for x in table[0].values()) for k in (0, 1))
        if not p0 or not n0:
            break
        best, gained = None, 0.0
        for f in sorted(table):
            p = n = 0
            for at in range(len(cuts[names[f]])):  # below cut number at: bins 0 .. at
                x, y = table[f].get(at, (0, 0))
                p, n = p + x, n + y
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if a >= LEAST_CASES and (g := a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))) > gained + 1e-9:
                        best, gained = (f, above, at), g
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list[tuple[int, bool, int]]) -> tuple[list[tuple[int, bool, int]], float]:
    """The beginning of the rule that is right most clearly on other rows, and how often, in %."""
    if not rule:
        return [], 0.0
    sums = [F.count_if(F.expr(_on_bins(rule[:k])) & y).alias(f"{s}{k}") for k in range(1, len(rule) + 1) for s, y in (("p", F.col("bad")), ("n", ~F.col("bad")))]
    r = rows.agg(*sums).head()
    scored = []
    for k in range(1, len(rule) + 1):
        p, n = r[f"p{k}"], r[f"n{k}"]
        if p + n:
            scored.append((p / (p + n), p, -k))
    if not scored:
        return [], 0.0
    enough = [s for s in scored if 100 * s[0] >= RIGHT_PERCENT]
    right, _, k = max(enough, key=lambda s: (s[1], s[2])) if enough else max(scored)
    return rule[:-k], 100 * right


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does. Over COUNTS."""
    sql = {name: f"cast(({s}) AS double)" for name, s in STATISTICS.items()}
    out = None
    for k, rule in enumerate(rules, 1):
        holds = F.expr(" AND ".join(f"{sql[t.statistic]} {'>=' if t.above else '<'} {t.threshold!r}D" for t in rule))
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judged(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """counted with rule, base_failed and kept."""
    return counted.withColumn("rule", decision(rules)).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    counted = written(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "counts")
    out = judged(counted, learn(counted, sampled(labels)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
