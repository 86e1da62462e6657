"""Queries that run through an index as it is kept: a stream of changes with state, the store, inverted lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import cells, lexical, search
from folioscan.operators.store import Store
from folioscan.plans import catalogue as Q
from folioscan.plans import corpus as C
from folioscan.plans.oracles import _CORPUS, _EXISTING, _STATUSES
from folioscan.plans.oracles import ORACLE_SQL as OTHERS
from folioscan.sources import files, store_source, tables
from folioscan.streaming import changes


def q50_stream_statuses(spark: SparkSession, d: str) -> DataFrame:
    """All documents three times as a stream, over three starts on one checkpoint: against what was there, a third of them changed, and the same again."""
    folder = Q._working_folder(spark)
    known = Q._existing(spark, d).select("path", "sha256")
    rows = spark.readStream.schema("path string, sha256 string, mtime double").parquet(f"{folder}/in*")
    changed = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("new"), "sha256")).otherwise(F.col("sha256"))
    for k, sha256 in enumerate((F.col("sha256"), changed, changed)):
        C.corpus(spark, d).select("path", sha256.alias("sha256"), F.lit(float(k)).alias("mtime")).write.mode("append").parquet(f"{folder}/in")
        changes.detect(rows, f"{folder}/out", f"{folder}/checkpoint", known).awaitTermination()
    out = spark.read.schema(changes.OUT).parquet(f"{folder}/out")
    return out.select(F.col("mtime").cast("int").alias("round"), F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long").alias("document_id"), "path", "status")


def _stored(spark: SparkSession, d: str, vectors: bool = False) -> Store:
    """All documents in a new store, each with its vector as a chunk if asked."""
    st = Store(spark, f"{Q._working_folder(spark)}/store")
    docs = C.corpus(spark, d).withColumn("mtime", F.lit(0.0))
    rows = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding").filter(F.lit(vectors)).join(docs.select("document_id", "path"), "document_id")
    chunks = rows.select("path", F.lit(0).alias("chunk_index"), F.lit("").alias("text"), F.lit("{}").alias("metadata"), F.lit(None).cast("int").alias("page"), "embedding")
    st.upsert(docs.select("path", "title", "sha256", "mtime", "size"), chunks)
    return st


def _id_of(title: str = "title") -> F.Column:
    return F.substring_index(title, "_", -1).cast("long")


def q51_store_delete(spark: SparkSession, d: str) -> DataFrame:
    """As q32, through a store: rows are marked as gone, no data file is written again."""
    st = _stored(spark, d)
    st.delete(document_id=st.documents().filter("title = 'doc_5'").head()["id"])
    st.delete(path="\\src7\\en\\doc_7.txt")
    return st.documents().select(_id_of().alias("document_id"), "path")


def q52_store_prune(spark: SparkSession, d: str) -> DataFrame:
    """As q33, through a store: what isn't there any more is marked, or its bucket written anew where most is gone."""
    st = _stored(spark, d)
    present = C.table(spark, d, "labels").select(F.col("doc_id").alias("document_id")).join(C.corpus(spark, d).select("document_id", "path"), "document_id")
    st.prune(present.select("path"))
    return st.documents().select(_id_of().alias("document_id"), "path")


def q53_store_folder_search(spark: SparkSession, d: str) -> DataFrame:
    """As q02, through a store, of which only the files are read that can have paths in the folders."""
    folders = ["/src1", "/SRC2/en"]
    rows = _stored(spark, d, vectors=True).searchable(folders).withColumn("document_id", _id_of())
    return search.top_k(rows, C.query_vector(spark, d), 10).select("document_id", "path", F.round("score", 6).alias("score"))


def q54_knn_inverted_lists(spark: SparkSession, d: str) -> DataFrame:
    """As q04, by inverted lists: cells are compared until no other can hold a better vector."""
    index = cells.inverted_lists(C.vectors(spark, d), f"{Q._working_folder(spark)}/lists")
    queries = C.table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best, _ = cells.top_k_each(index, queries, 5)
    return best.select("query_id", "rank", "document_id", F.round("score", 6).alias("score"))


def q55_chunks_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """As q13, in SQL over files' contents: the reader and the chunker are one table function."""
    tables.register(spark)
    files = C.corpus(spark, d).select("document_id", "path", F.encode("text", "UTF-8").alias("content"))
    return spark.sql("SELECT f.document_id, c.chunk_index, c.text, c.page FROM {files} f, LATERAL file_chunks(f.path, f.content, 500, 50) c WHERE c.error IS NULL", files=files)


def q56_sections_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """As q14, in SQL: conversations as Markdown files, read by their extension."""
    tables.register(spark)
    turns = C.table(spark, d, "conversations")
    return spark.sql(
        "WITH t AS (SELECT conv_id, array_sort(collect_list(struct(turn, '# ' || role || '\n**' || text || '**\n' AS part))) AS parts FROM {turns} GROUP BY conv_id) "
        "SELECT t.conv_id, p.page, p.text FROM t, LATERAL file_pages('conversation.md', encode(array_join(transform(parts, x -> x.part), ''), 'UTF-8')) p WHERE p.error IS NULL",
        turns=turns,
    )


def q57_scan_report(spark: SparkSession, d: str) -> DataFrame:
    """q34, q46 and q47 in one pass: the total, each extension, each large file."""
    return files.scan_report(Q._page_files(spark, d), 3000)


def q58_rerank_by_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of q05 ordered by BM25, with the words' statistics that a store kept over a first commit, an update of a third and a deletion."""
    st = Store(spark, f"{Q._working_folder(spark)}/store", terms=True)
    docs = C.corpus(spark, d).withColumn("mtime", F.lit(0.0))
    vectors = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    third = F.col("document_id") % 3 == 0
    for k, rows in enumerate((docs.withColumn("sha256", F.when(third, "old").otherwise(F.col("sha256"))).withColumn("text", F.when(third, "of the old").otherwise(F.col("text"))), docs.filter(third))):
        chunks = rows.join(vectors, "document_id").select("path", F.lit(0).alias("chunk_index"), "text", F.lit("{}").alias("metadata"), F.lit(None).cast("int").alias("page"), "embedding")
        st.upsert(rows.select("path", "title", "sha256", (F.col("mtime") + k).alias("mtime"), "size"), chunks)
    st.delete(document_id=st.documents().filter("title = 'doc_5'").head()["id"])
    rows = st.searchable().withColumn("document_id", _id_of())
    hits = search.search(rows, C.query_vector(spark, d), 10, logit=lexical.bm25_logit(Q.QUESTION, st.terms()))
    return hits.select("document_id", *(F.round(c, 6).alias(c) for c in ("score", "embedding_score", "rerank_score")))


def q59_store_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their vectors handed in by two jobs through the data source, absorbed, a seventh pruned; one folder read back by a pushed filter, with chunks counted."""
    store_source.register(spark)
    root = f"{Q._working_folder(spark)}/store"
    docs = C.corpus(spark, d).withColumn("mtime", F.lit(0.0))
    chunk = F.struct(F.lit(0).alias("chunk_index"), F.lit("").alias("text"), F.lit("{}").alias("metadata"), F.lit(None).cast("int").alias("page"), "embedding")
    vectors = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.array(chunk).alias("chunks"))
    rows = docs.join(vectors, "document_id", "left")
    for half in (0, 1):
        rows.filter(F.col("document_id") % 2 == half).select("path", "title", "sha256", "mtime", "size", "chunks").write.format("folioscan").mode("append").save(root)
    st = Store(spark, root)
    store_source.absorb(st)
    st.prune(docs.filter("document_id % 7 != 0").select("path"))
    source = spark.read.format("folioscan")
    counts = source.option("table", "chunks").load(root).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    found = source.option("table", "documents").load(root).filter(F.col("path").startswith("/src1/")).join(counts, "id", "left")
    return found.select(_id_of().alias("document_id"), "path", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q50_stream_statuses, q51_store_delete, q52_store_prune, q53_store_folder_search, q54_knn_inverted_lists, q55_chunks_by_sql, q56_sections_by_sql, q57_scan_report, q58_rerank_by_corpus, q59_store_source)}
_SCANNED = (
    "WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', '') AS path, length(html)::BIGINT AS n FROM pages), "
    "x AS (SELECT path, n, lower(regexp_extract(path, '[^/\\\\](\\.[^./\\\\]+)$', 1)) AS ext FROM p) "
)
# BM25 with k1 = 1.2 and b = 0.75, one term for each of the question's words in alphabetical order.
_BM25 = " + ".join(f"ln(1 + (n - df[{k}] + 0.5) / (df[{k}] + 0.5)) * len(list_filter(ws, lambda x: x = '{w}')) * 2.2 / (len(list_filter(ws, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len(ws) / (total / n)))" for k, w in enumerate(["and", "is", "of", "the", "what"], 1))
_LATER = "SELECT {k} AS round, document_id, path, {status} AS status FROM corpus"
ORACLE_SQL: dict[str, str] = {
    "q50_stream_statuses": f"WITH {_CORPUS}, {_EXISTING}, {_STATUSES} SELECT 0 AS round, document_id, path, status FROM st UNION ALL "
    + _LATER.format(k=1, status="CASE WHEN document_id % 3 = 0 THEN 'updated' ELSE 'skipped' END") + " UNION ALL " + _LATER.format(k=2, status="'skipped'"),
    "q51_store_delete": OTHERS["q32_delete"],
    "q52_store_prune": OTHERS["q33_prune_missing"],
    "q53_store_folder_search": OTHERS["q02_knn_folder_filter"],
    "q54_knn_inverted_lists": OTHERS["q04_knn_batch"],
    "q55_chunks_by_sql": OTHERS["q13_chunk_paged"],
    "q56_sections_by_sql": OTHERS["q14_md_sections"],
    "q59_store_source": f"WITH {_CORPUS} SELECT document_id, path, count(e.vec_id) AS chunk_count FROM corpus c LEFT JOIN embeddings e ON e.vec_id = c.document_id WHERE starts_with(path, '/src1/') AND document_id % 7 <> 0 GROUP BY 1, 2",
    "q57_scan_report": _SCANNED + "SELECT 'total' AS kind, NULL::VARCHAR AS name, count(*) AS file_count, coalesce(sum(n), 0)::BIGINT AS total_size, count(*) FILTER (n >= 3000) AS large_count FROM x "
    "UNION ALL SELECT 'type', ext, count(*), sum(n)::BIGINT, count(*) FILTER (n >= 3000) FROM x GROUP BY ext UNION ALL SELECT 'large', path, count(*), sum(n)::BIGINT, count(*) FROM x WHERE n >= 3000 GROUP BY path, n",
    "q58_rerank_by_corpus": f"WITH {_CORPUS}, t AS (SELECT c.document_id, list_filter(string_split_regex(lower(c.text), '\\s+'), lambda x: x <> '') AS ws, list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS raw "
    "FROM embeddings e JOIN corpus c ON e.vec_id = c.document_id WHERE c.document_id <> 5), "
    "s AS (SELECT count(*) AS n, sum(len(ws)) AS total, [count(*) FILTER (list_contains(ws, 'and')), count(*) FILTER (list_contains(ws, 'is')), count(*) FILTER (list_contains(ws, 'of')), count(*) FILTER (list_contains(ws, 'the')), count(*) FILTER (list_contains(ws, 'what'))] AS df FROM t), "
    f"h AS (SELECT document_id, raw, {_BM25} AS logit FROM (SELECT * FROM t ORDER BY raw DESC, document_id LIMIT 30) c, s) "
    "SELECT document_id, round(1 / (1 + exp(-logit)), 6) AS score, round(raw, 6) AS embedding_score, round(logit, 6) AS rerank_score FROM h ORDER BY 1 / (1 + exp(-logit)) DESC, raw DESC, document_id LIMIT 10",
}
