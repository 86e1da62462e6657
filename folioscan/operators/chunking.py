"""Splitting texts: fixed strides, streams, and sentence-aware chunks with page labels."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.batches import in_batches, small_batches, values

# Where sentences and paragraphs end, and what is too short to stand alone.
SHORT_FRAGMENT = 20
_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\u00C0-\u024F\d\"'(\[])|(?<=\n)\n+")
PAGE_CHARS, PAGE_TAIL = 3000, 600


def fixed_chunks(text: Column, max_chars: int = 1200, overlap: int = 200) -> Column:
    """Strides of max_chars - overlap, short stubs at the end included."""
    step = max(max_chars - overlap, 1)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(max_chars))))


def stream_chunks(text: Column, max_chars: int = 1200, overlap: int = 200) -> Column:
    """As many full chunks as fit, then what remains, once."""
    step = max(max_chars - overlap, 1)
    full = F.when(F.length(text) >= max_chars, F.floor((F.length(text) - max_chars) / step).cast("int") + 1).otherwise(0)
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda k: F.substring(text, k * step + 1, F.lit(max_chars)))).otherwise(F.array().cast("array<string>"))
    rest = F.substring(text, full * step + 1, F.length(text))
    return F.when(rest == "", whole).otherwise(F.concat(whole, F.array(rest)))


def split_sentences(text: str) -> list[str]:
    """Sentences of a text; a fragment after one shorter than SHORT_FRAGMENT characters is joined to it."""
    out: list[str] = []
    for part in _END.split(text) if text else ():
        if out and len(out[-1]) < SHORT_FRAGMENT:
            out[-1] += part
        else:
            out.append(part)
    return [s for s in out if s.strip()]


def _cut(docs: DataFrame, key: str, columns: str, parts: Callable[[str], Iterable[tuple]], text: int) -> DataFrame:
    """key and columns (int or string): the tuples that parts(text) gives for each row; the one at place text is a text. Parts leave the task in bounded pieces, as they are made."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        given = [(c, pa.int32() if kind == "int" else pa.string()) for c, kind in (x.split() for x in columns.split(", "))]
        for batch in batches:
            rows = ((name, *part) for name, t in values([batch]) for part in parts(t or ""))
            yield from in_batches(rows, pa.schema([(key, batch.column(0).type), *given]), lambda row: len(row[text + 1]))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {columns}")


def sentence_rows(docs: DataFrame, key: str) -> DataFrame:
    """key, sentence (from 0), text: the sentences of the column text, in one pass over each."""
    return _cut(docs, key, "sentence int, text string", lambda text: enumerate(split_sentences(text)), 1)


def sentence_chunks(pages: Iterable[tuple[int, str]], max_chars: int, overlap: int) -> Iterator[tuple[str, int]]:
    """(chunk, page). A chunk is a run of sentences [first, k); k opens the next one, which begins with
    the longest run before k of at most overlap characters, one sentence at least. Its page is that of
    sentence k; the first chunk's is that of the first sentence."""
    found = [(s, page) for page, text in pages for s in split_sentences(text)]
    if not found:
        return
    before = [0, *accumulate(len(s) for s, _ in found)]
    first, label = 0, found[0][1]
    for k in range(1, len(found)):
        if before[k + 1] - before[first] > max_chars:
            yield "".join(s for s, _ in found[first:k]), label
            first, label = bisect_left(before, before[k] - overlap, first, k - 1), found[k][1]
    yield "".join(s for s, _ in found[first:]), label


def text_pages(text: str) -> list[tuple[int, str]]:
    """Virtual pages of PAGE_CHARS, broken after the last newline of the last PAGE_TAIL characters; blank ones count but go."""
    out, start, number = [], 0, 0
    while start < len(text):
        end, number = start + PAGE_CHARS, number + 1
        if end < len(text):
            end = (text.rfind("\n", end - PAGE_TAIL, end) + 1) or end
        if text[start:end].strip():
            out.append((number, text[start:end]))
        start = end
    return out


def chunked(docs: DataFrame, key: str, max_chars: int, overlap: int, paged: bool = False) -> DataFrame:
    """key, chunk_index, text, page: sentence-aware chunks of the column text, or of its virtual pages."""

    def parts(text: str) -> Iterator[tuple[int, str, int]]:
        for k, (chunk, page) in enumerate(sentence_chunks(text_pages(text) if paged else [(1, text)], max_chars, overlap)):
            yield k, chunk, page

    return _cut(docs, key, "chunk_index int, text string, page int", parts, 1)


def paged(docs: DataFrame, key: str) -> DataFrame:
    """key, page, text: virtual pages of plain text."""
    return _cut(docs, key, "page int, text string", text_pages, 1)


def paragraph_pages(lines: DataFrame, key: str, order: str, per_page: int = 10) -> DataFrame:
    """key, page, text: non-blank stripped lines, per_page to a page. Columns: key, order, text."""
    from pyspark.sql.window import Window

    from folioscan.functions.scalars import strip

    kept = lines.withColumn("text", strip(F.col("text"))).filter("text != ''")
    numbered = kept.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    paged = numbered.withColumn("page", (F.floor((F.col("n") - 1) / per_page) + 1).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    return paged.groupBy(key, "page").agg(F.concat(joined, F.lit("\n")).alias("text"))
