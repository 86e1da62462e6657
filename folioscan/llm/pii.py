"""Operator 2, personal data: fixed patterns, and terms that the corpus shows to reveal it.

Base spans (e-mail, ip, card, phone; leftmost, not overlapping within a kind; matches that fail
their test are dropped) are the protected entities. Beside them, an information-theoretic pass:

1. Around each entity, the WINDOW words before and after, however far, are candidate terms. A (term,
   entity) pair is counted by its distinct neighbourhoods, the words next to the term in the text:
   copies of one passage are one piece of evidence, whatever their number. Pairs of LEAST_CONTEXTS
   neighbourhoods go on.
2. For these terms only, the corpus gives n(term), the distinct neighbourhoods in all texts; a term
   is dropped as soon as it has too many for any disclosure. The
   disclosure of entity by term is P(entity | term) = n(term, entity) / n(term), and the information
   gained is log2(P(entity | term) / P(entity)) bits, P(entity) being its share of distinct texts.
3. Terms that gain at least LEAST_BITS and reveal an entity with P >= REMOVE_AT are removed wherever
   they stand (kind "term"); from GENERALISE_AT on they are generalised (kind "general").

Up to BROADCAST_TERMS terms are broadcast, counted first; more are met by a join on the words, which
are cut in the same way, so results don't depend on their number. Spans of a text are found, told
apart and replaced in one sorted sweep, so a long text takes time in proportion. Ties: of two spans
that overlap, the longer is replaced, of equally long ones the first. Null text: empty, no spans.
Null ids: returned as they are. Repeated rows: one result each. No rows: no rows. Further columns
don't matter to find(), and sanitise() returns them unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, lean, small_batches, text_of, written

if TYPE_CHECKING:
    import numpy as np

WINDOW, LEAST_CONTEXTS, LEAST_BITS, REMOVE_AT, GENERALISE_AT = 6, 3, 6.0, 0.8, 0.5
BROADCAST_TERMS = 200_000
#: Neighbourhoods, and pairs with theirs, that a task holds before it sends them.
HELD_CONTEXTS, HELD_PAIRS = 200_000, 50_000
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive: a run of digits is never given up, which changes no match and keeps long runs linear.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "", "general": "[TERM]"}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as in KINDS, then start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            done = end.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def term_spans(text: str, terms: dict[str, str], base: list[Span]) -> list[Span]:
    """Where the terms stand, apart from base spans; by kind, then start. One sweep over both."""
    if not terms:
        return []
    taken = merged(base)
    found, k = [], 0
    for m in WORD.finditer(text):
        kind = terms.get(m[0].lower())
        if kind:
            start, end = m.span()
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k == len(taken) or end <= taken[k][0]:
                found.append((kind, start, end))
    return sorted(found, key=lambda s: (s[0] != "term", s[1]))


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((b, e) for _, b, e in spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced; where spans overlap, the longer one holds, of equal ones the first."""
    chosen: list[Span] = []  # by start
    groups: list[list[Span]] = []  # of spans that hang together
    reach = -1
    for s in sorted(spans, key=lambda s: (s[1], s[2])):
        if s[1] < reach:
            groups[-1].append(s)
        else:
            groups.append([s])
        reach = max(reach, s[2])
    for group in groups:
        own_starts: list[int] = []
        own: list[Span] = []
        for s in sorted(group, key=lambda s: (s[1] - s[2], s[1])) if len(group) > 1 else group:
            at = bisect_left(own_starts, s[1])
            if (at == 0 or own[at - 1][2] <= s[1]) and (at == len(own) or s[2] <= own[at][1]):
                own_starts.insert(at, s[1])
                own.insert(at, s)
        chosen += own
    out, at = [], 0
    for kind, start, end in chosen:
        out += [text[at:start], REPLACED[kind]]
        at = end
    return "".join(out) + text[at:]


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    import numpy as np

    flat = np.fromiter((x for m in WORD.finditer(text) for x in m.span()), np.int64)
    return flat[::2], flat[1::2]


def _context(before: str, after: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1


def neighbours(text: str, spans: list[Span]) -> Iterator[tuple[str, str, int]]:
    """(term, entity, context): each word within WINDOW words of an entity, however far, with its neighbourhood.

    A neighbourhood is the words next to a term in the whole text, as all_contexts() has it.
    Words that overlap the entity itself are no terms.
    """
    import numpy as np

    starts, ends = _words(text)

    def word(k: int) -> str:
        return text[starts[k] : ends[k]].lower() if 0 <= k < len(starts) else ""

    for kind, start, end in spans:
        entity = f"{kind}:{text[start:end].lower()}"
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end, "left"))
        for k in (*range(max(0, i - WINDOW), i), *range(j, min(len(starts), j + WINDOW))):
            yield word(k), entity, _context(word(k - 1), word(k + 1))


def all_contexts(text: str) -> Iterator[tuple[str, int, int]]:
    """(term, the word before, the word after) for each word of the text."""
    before, now = "", None
    for m in WORD.finditer(text):
        after = m[0].lower()
        if now is not None:
            yield now, before, after
            before = now
        now = after
    if now is not None:
        yield now, before, ""


def revealing_terms(docs: DataFrame) -> DataFrame:
    """term, kind (term or general), bits, share: a table in the shared folder. docs: doc_id, text (not null)."""

    def pairs(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        def sent(rows: set, seen: set) -> pa.RecordBatch:
            both = [*rows, *seen]
            return pa.RecordBatch.from_pydict({"term": pa.array([r[0] for r in both], pa.string()), "entity": pa.array([r[1] for r in both], pa.string()), "context": pa.array([r[2] for r in both], pa.int64())})

        rows: set[tuple] = set()
        seen: set[tuple] = set()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                own = xxhash.xxh3_64_intdigest(text) >> 1
                seen.add((None, None, own))
                spans = base_spans(text)
                for row in neighbours(text, spans) if spans else ():
                    rows.add(row)
                    if len(rows) > HELD_PAIRS:
                        yield sent(rows, seen)
                        rows, seen = set(), set()
                seen.update((None, f"{kind}:{text[b:e].lower()}", own) for kind, b, e in spans)
                if len(seen) > HELD_PAIRS:
                    yield sent(rows, seen)
                    rows, seen = set(), set()
        yield sent(rows, seen)

    spark = docs.sparkSession
    small_batches(spark)
    found = written(docs.select("text").mapInArrow(pairs, "term string, entity string, context long"), "pairs")
    # Entities and texts are both counted by distinct text, so copies weigh nothing.
    texts = found.filter("term IS NULL").distinct()
    n_docs = max(1, texts.filter("entity IS NULL").count())
    entities = texts.filter("entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = written(found.filter("term IS NOT NULL").distinct().groupBy("term", "entity").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= LEAST_CONTEXTS), "both")
    # With more neighbourhoods than this, no entity's share of them reaches GENERALISE_AT.
    terms = both.groupBy("term").agg(F.floor(F.max("n_both") / GENERALISE_AT).alias("most"))
    corpus = _contexts_of(docs, terms)
    strength = both.join(corpus, "term").join(entities, "entity").withColumn("share", F.col("n_both") / F.col("n_term")).withColumn("bits", F.log2(F.col("share") * n_docs / F.col("n_entity")))
    best = strength.filter(F.col("bits") >= LEAST_BITS).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")).filter(F.col("share") >= GENERALISE_AT)
    out = written(best.select("term", F.when(F.col("share") >= REMOVE_AT, "term").otherwise("general").alias("kind"), "bits", "share"), "terms")
    for t in (found, both):
        dropped(t)
    return out


def _contexts_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: distinct neighbourhoods in all texts of the terms (term, most).

    A term with more than most neighbourhoods is common and reveals nothing; a task that has seen
    more of them says so in one row instead of sending them, and the term goes.
    """
    n = terms.count()
    chosen = docs.sparkSession.sparkContext.broadcast({r["term"]: r["most"] for r in terms.collect()}) if n <= BROADCAST_TERMS else None

    def contexts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean()
        wanted = chosen.value if chosen is not None else None
        held: dict[str, set[int]] = {}
        common: set[str] = set()
        size = 0

        def sent() -> Iterator:
            for term, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([term] * len(found), pa.string()), pa.array(found, pa.int64())], names=["term", "context"])

        for batch in batches:
            for text in batch.column(0) if n else ():
                text = text.as_py()
                if wanted is not None and wanted.keys().isdisjoint(map(str.lower, WORD.findall(text))):
                    continue
                for term, before, after in all_contexts(text):
                    if (wanted is None or term in wanted) and term not in common:
                        found = held.setdefault(term, set())
                        size -= len(found)
                        found.add(_context(before, after))
                        size += len(found)
                        if wanted is not None and len(found) > wanted[term]:
                            size -= len(held.pop(term))
                            common.add(term)
                        if size > HELD_CONTEXTS:
                            yield from sent()
                            held, size = {}, 0
        yield from sent()
        yield pa.RecordBatch.from_pydict({"term": pa.array(sorted(common), pa.string()), "context": pa.array([None] * len(common), pa.int64())})

    rows = docs.select("text").mapInArrow(contexts, "term string, context long")
    if chosen is None:
        rows = rows.join(terms.select("term"), "term", "left_semi")
    return rows.distinct().groupBy("term").agg(F.count("context").alias("n_term"), F.count_if(F.col("context").isNull()).alias("common")).filter("common = 0").drop("common")


def _distinct_words(batches: Iterator) -> Iterator:
    """_row and each of the text's words, cut and put in lower case as everywhere here."""
    import pyarrow as pa

    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = list({m[0].lower() for m in WORD.finditer(text.as_py() or "")})
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(words, pa.string())], names=["_row", "term"])


def with_terms(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, object]:
    """docs and a last column, whatever the others' names: the (term, kind) pairs in each text where there are too many to broadcast, else null; and the broadcast."""
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns}
    row, last = (next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("_row", "own_terms"))
    if terms.count() <= BROADCAST_TERMS:
        return docs.withColumn(last, F.lit(None).cast("map<string,string>")), spark.sparkContext.broadcast({r["term"]: r["kind"] for r in terms.collect()})
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    words = numbered.select(row, "text").mapInArrow(_distinct_words, "_row long, term string")
    own = words.join(terms, "term").groupBy(F.col("_row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias(last))
    return numbered.join(own, row, "left").select(*docs.columns, last), None


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marked, shared = with_terms(rows, revealing_terms(rows))

    def found(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for name, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = base_spans(text)
                more = term_spans(text, shared.value if shared is not None else dict(own or ()), base)
                listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                out.append((name, *(sum(1 for s in base if s[0] == k) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in base + more), len(more)))
            kinds = (pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"
    return marked.mapInArrow(found, schema)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the spans of its texts replaced; null texts stay null, all other columns as they are."""
    rows = docs.select("doc_id", text_of().alias("text"))
    terms = revealing_terms(rows)
    marked, shared = with_terms(docs, terms)
    schema = docs.schema
    place = docs.columns.index("text")

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean()
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None:
                    base = base_spans(text)
                    spans = base + term_spans(text, shared.value if shared is not None else dict(own or ()), base)
                    text = sanitised(text, spans) if spans else text
                texts.append(text)
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(clean, schema)
