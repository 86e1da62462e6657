"""Context around hits: whole documents, index windows, page rings, character budgets, several documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.schema import CONTEXT_CHARS, MIN_REMAINDER, SMALL_DOCUMENT, WINDOW

MORE = " [...]"


def window(chunks: DataFrame, hits: DataFrame, size: int = WINDOW) -> DataFrame:
    """Chunks whose index is within size of a hit's (document_id, center). One equi-join with a band."""
    near = F.col("chunk_index").between(F.greatest(F.col("center") - size, F.lit(0)), F.col("center") + size)
    return chunks.select("document_id", "chunk_index", "text").join(hits, "document_id").filter(near).select("document_id", "center", "chunk_index", "text")


def by_page(chunks: DataFrame, hits: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Chunks of a hit's page (document_id, center_page), whole, then of the rings of pages around it while the budget isn't reached.

    Within a ring the lower page comes first; an empty ring ends it.
    """
    rows = chunks.join(hits, "document_id").withColumn("d", F.abs(F.col("page") - F.col("center_page"))).filter("page >= 0 OR d = 0")
    target = Window.partitionBy("document_id", "center_page", F.when(F.col("d") == 0, 0).otherwise(1))
    rows = rows.withColumn("ring", F.dense_rank().over(target.orderBy("d"))).filter("d = 0 OR ring = d")
    earlier = Window.partitionBy("document_id", "center_page").orderBy("d", "page", "chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(earlier), F.lit(0)))
    return rows.filter(F.col("before") * F.when(F.col("d") == 0, 0).otherwise(1) < max_chars).select("document_id", "center_page", "chunk_index", "page", "text")


def hybrid(chunks: DataFrame, hits: DataFrame, size: int = WINDOW, small: int = SMALL_DOCUMENT) -> DataFrame:
    """For hits (hit_rank, document_id, path, center): all of a small document, else the window; each chunk once, at its first hit."""
    counts = chunks.join(hits.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))
    wanted = hits.join(counts, "document_id")
    rows = chunks.join(wanted, "document_id").filter((F.col("n") <= small) | F.col("chunk_index").between(F.col("center") - size, F.col("center") + size))
    first = Window.partitionBy("document_id", "chunk_index").orderBy("hit_rank")
    return rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select("hit_rank", "document_id", "path", "chunk_index", "text")


def _cut(text: Column, room: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), room.cast("int")), F.lit(MORE))


def budget(chunks: DataFrame, by: list[str], max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Each group's chunks in order of chunk_index while they fit; the first that doesn't is cut if more than MIN_REMAINDER characters are left."""
    w = Window.partitionBy(*by).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumn("cum", F.sum(F.length("text")).over(w)).withColumn("over", F.sum((F.col("cum") > max_chars).cast("int")).over(w))
    room = F.lit(max_chars) - (F.col("cum") - F.length("text"))
    kept = rows.filter((F.col("over") == 0) | ((F.col("over") == 1) & (room > MIN_REMAINDER)))
    return kept.withColumn("text", F.when(F.col("over") == 0, F.col("text")).otherwise(_cut(F.col("text"), room))).select(*by, "chunk_index", "text")


def joined(chunks: DataFrame, by: list[str], separator: str = "\n\n") -> DataFrame:
    """One text for each group, in order of chunk_index."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return chunks.groupBy(*by).agg(F.array_join(texts, separator).alias("context"))


def assembled(chunks: DataFrame, by: list[str] | None = None, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """hybrid()'s chunks as one text: for each document, by its first hit, a header and its chunks, within the budget.

    Headers count, separators don't. A chunk that doesn't fit ends its document (it is cut if more
    than MIN_REMAINDER characters are left), and nothing follows once the budget is reached; else
    the next document may begin. The fold runs over the chunks of one answer.
    """
    order = Window.partitionBy("document_id", *(by or []))
    rows = chunks.withColumn("first_hit", F.min("hit_rank").over(order)).select(
        *(by or []), F.struct("first_hit", "document_id", "chunk_index", F.concat(F.lit("--- Document: "), "path", F.lit(" ---")).alias("header"), "text").alias("c")
    )
    listed = F.sort_array(F.collect_list("c"))
    grouped = (rows.groupBy(*by) if by else rows.groupBy()).agg(listed.alias("cs"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("total"), F.lit(-1).cast("bigint").alias("doc"), F.lit(False).alias("closed"), F.lit(False).alias("done"))

    def state(out: Column, total: Column, doc: Column, closed: Column, done: Column) -> Column:
        return F.struct(out.alias("out"), total.cast("int").alias("total"), doc.cast("bigint").alias("doc"), closed.alias("closed"), done.alias("done"))

    def step(s: Column, c: Column) -> Column:
        fresh = c["document_id"] != s["doc"]
        # A new document: over if the budget is reached, else its header.
        done = s["done"] | (fresh & (s["doc"] >= 0) & (s["total"] >= max_chars))
        head = F.when(s["out"] == "", c["header"]).otherwise(F.concat(s["out"], F.lit("\n\n"), c["header"]))
        out, total = F.when(fresh, head).otherwise(s["out"]), F.when(fresh, s["total"] + F.length(c["header"])).otherwise(s["total"])
        closed = ~fresh & s["closed"]
        room = F.lit(max_chars) - total
        fits = F.length(c["text"]) <= room
        longer = F.when(fits, F.concat(out, F.lit("\n\n"), c["text"])).when(room > MIN_REMAINDER, F.concat(out, F.lit("\n\n"), _cut(c["text"], room))).otherwise(out)
        more = state(longer, F.when(fits, total + F.length(c["text"])).otherwise(total), c["document_id"], ~fits, F.lit(False))
        return F.when(done, state(s["out"], s["total"], s["doc"], s["closed"], F.lit(True))).when(closed, s).otherwise(more)

    return grouped.select(*(by or []), F.aggregate("cs", start, step, lambda s: s["out"]).alias("context"))


def page_or_window(chunks: DataFrame, hits: DataFrame, max_chars: int = CONTEXT_CHARS, size: int = WINDOW) -> DataFrame:
    """document_id, chunk_index, text around one hit a document (document_id, center): by its page, or its window if it has none."""
    hit = Window.partitionBy("document_id", "center")
    rows = chunks.join(hits, "document_id").withColumn("center_page", F.max(F.when(F.col("chunk_index") == F.col("center"), F.col("page"))).over(hit))
    rows = rows.withColumn("paged", F.col("center_page").isNotNull()).withColumn("d", F.abs(F.col("page") - F.col("center_page")))
    near = F.col("chunk_index").between(F.greatest(F.col("center") - size, F.lit(0)), F.col("center") + size)
    rows = rows.filter(F.when(F.col("paged"), (F.col("page") >= 0) | (F.col("d") == 0)).otherwise(near))
    # From here on as by_page(); rows without pages pass, and chunks are cut and read once for both.
    ring = F.dense_rank().over(Window.partitionBy("document_id", "center", F.coalesce(F.col("d") == 0, F.lit(False))).orderBy("d"))
    rows = rows.withColumn("ring", ring).filter("NOT paged OR d = 0 OR ring = d")
    earlier = hit.orderBy("d", "page", "chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(earlier), F.lit(0)))
    return rows.filter((~F.col("paged")) | (F.col("d") == 0) | (F.col("before") < max_chars)).select("document_id", "chunk_index", "text")
