"""All queries of the engine over the corpus tables, by name. Their SQL is in oracles.py."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import scalars, vectors
from folioscan.operators import answers, chunking, context, indexer, prompts, search, store, tiers
from folioscan.plans import corpus as C
from folioscan.plans.oracles import ORACLE_SQL
from folioscan.sources import files
from folioscan.streaming.incremental import upsert_stream

QUESTION = "What is the of and the"
__all__ = ["ORACLE_SQL", "QUERIES"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus(spark, d).select("document_id", "path", "text")


def q01_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.shown(search.top_k(C.vectors(spark, d), C.query_vector(spark, d), 10), _documents(spark, d))
    return _rounded(hits).select("document_id", "path", "score")


def q02_knn_folder_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_k(C.vectors_with_paths(spark, d), C.query_vector(spark, d), 10, ["/src1", "/SRC2/en"])).select("document_id", "path", "score")


def q03_knn_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_k(C.vectors_with_paths(spark, d), C.query_vector(spark, d), None)).select("document_id", "path", "score")


def q04_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    queries = C.table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _rounded(search.top_k_each(C.vectors(spark, d), queries, 5)).select("query_id", "rank", "document_id", "score")


def q05_rerank_two_stage(spark: SparkSession, d: str) -> DataFrame:
    found = search.shown(search.top_k(C.vectors(spark, d), C.query_vector(spark, d), search.candidates(10)), _documents(spark, d))
    hits = search.reranked(found, search.lexical_logit(QUESTION), 10)
    return hits.select("document_id", *(F.round(c, 6).alias(c) for c in ("score", "embedding_score", "rerank_score")))


def q06_threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = search.top_k(C.vectors(spark, d), C.query_vector(spark, d), 30).select("document_id", "score")
    low = hits.select("document_id", (F.col("score") / 100).alias("score")).withColumn("query_id", F.lit(1))
    return _rounded(search.relevant(hits.withColumn("query_id", F.lit(0)).unionByName(low), by="query_id"))


def q07_result_format(spark: SparkSession, d: str) -> DataFrame:
    hits = search.shown(search.top_k(C.vectors(spark, d), C.query_vector(spark, d), 10), _documents(spark, d))
    return hits.select(
        "document_id", scalars.snippet(F.col("text")).alias("snippet"), F.format_string("%.4f", F.round("score", 4)).alias("score_text"), scalars.percent(F.round("score", 6)).alias("percent"),
        F.regexp_extract("path", r"\.([^.]+)$", 1).alias("ext"), scalars.short_path(F.col("path")).alias("short_path"), scalars.escape_html(F.concat(F.lit("<b>"), "path", F.lit("</b>"))).alias("escaped"),
    )


def _exploded(spark: SparkSession, d: str, parts) -> DataFrame:  # noqa: ANN001
    return C.table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("chunk_index", "text"))


def q08_chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, d, chunking.fixed_chunks(F.col("text")))


def q09_chunk_stream(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, d, chunking.stream_chunks(F.col("text")))


def q10_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_rows(C.table(spark, d, "documents"), "doc_id")


def q11_chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(spark, d).drop("page")


def q12_txt_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paged(C.corpus(spark, d), "document_id")


def q13_chunk_paged(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(spark, d, paged=True)


def q14_md_sections(spark: SparkSession, d: str) -> DataFrame:
    turns = C.table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n**"), "text", F.lit("**\n"))).alias("t"))
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["col2"]), "").alias("text"))
    return files.markdown_pages(texts, "conv_id")


def q15_para_pages(spark: SparkSession, d: str) -> DataFrame:
    lines = C.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return chunking.paragraph_pages(lines, "doc_id", "line")


def q16_normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents").select("doc_id", scalars.normalize_whitespace(F.replace("text", F.lit("."), F.lit(" \n \n"))).alias("text"))


def q17_table_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("k"), F.col("n_nationkey").cast("string").alias("a"), F.col("n_name").alias("b"), F.when(F.col("n_regionkey") != 2, F.concat_ws("\n", F.lit("r"), F.col("n_regionkey").cast("string"))).alias("c"))
    head = spark.createDataFrame([(0, "key", "name", "region")], "k int, a string, b string, c string")
    return files.table_markdown(head.unionByName(rows.withColumn("k", F.col("k").cast("int"))), "k", ["a", "b", "c"])


BLOCKS = "(1,0,0,100,20,' top ',0),(1,10,50,90,100,'in table',0),(1,0,90,100,140,'half out',0),(1,0,200,50,220,'image',1),(1,0,300,100,320,'end',0),(2,0,0,10,10,'only',0),(2,0,20,10,20,'flat',0)"
TABLES = "(1,0,40,100,110,'| t |'),(2,0,100,10,120,'')"


def q18_block_table_overlap(spark: SparkSession, d: str) -> DataFrame:
    blocks = spark.sql(f"SELECT * FROM VALUES {BLOCKS} AS t(page,x0,y0,x1,y1,text,type)")
    tables = spark.sql(f"SELECT * FROM VALUES {TABLES} AS t(page,x0,y0,x1,y1,markdown)")
    return files.page_layout(blocks, tables, ["page"])


def _existing(spark: SparkSession, d: str) -> DataFrame:
    rows = C.corpus(spark, d).drop("text").filter("document_id % 4 != 0")
    return rows.withColumn("sha256", F.when(F.col("document_id") % 5 == 0, F.concat(F.lit("old"), "sha256")).otherwise(F.col("sha256"))).withColumn("path", F.replace("path", F.lit("/"), F.lit("\\")))


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    return store.statuses(_existing(spark, d), C.corpus(spark, d).drop("text"))


def q19_change_detection(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d).select("document_id", "path", "status")


def q20_upsert_state(spark: SparkSession, d: str) -> DataFrame:
    return store.upserted(_existing(spark, d), C.corpus(spark, d).drop("text"))


def q21_index_stats(spark: SparkSession, d: str) -> DataFrame:
    odd = _statuses(spark, d).withColumn("status", F.when(F.col("document_id") % 50 == 3, "error").otherwise(F.col("status")))
    return store.index_stats(odd)


def _catalogued(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as catalogue rows, with times made from ids."""
    created = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("document_id"))
    return C.corpus(spark, d).select(
        F.col("document_id").alias("id"), "path", "title", "sha256", (F.col("document_id") + 0.5).alias("mtime"), "size", created.alias("created_at"), F.timestamp_seconds(F.unix_seconds(created) + F.pmod(F.col("document_id") * 7919, F.lit(100_000))).alias("updated_at")
    )


def q22_list_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = store.document_list(_catalogued(spark, d), C.chunks(spark, d))
    return rows.select("id", "path", "title", "sha256", "mtime", "size", F.unix_seconds("created_at").alias("created_at"), F.unix_seconds("updated_at").alias("updated_at"), "chunk_count")


def q23_list_directories(spark: SparkSession, d: str) -> DataFrame:
    rows = C.corpus(spark, d).withColumn("path", F.when(F.col("document_id") % 2 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path")))
    extra = spark.createDataFrame([("x.txt",), ("/x.txt",), ("C:\\a\\x",), ("C:/a/y",)], "path string")
    return store.directories(rows.select("path").unionByName(extra))


def q24_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.totals(C.corpus(spark, d), C.chunks(spark, d))


def q25_all_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chunks(spark, d, only=F.col("document_id") == 3).select("document_id", "chunk_index", "text")
    return rows.withColumn("chunk_count", F.count("*").over(Window.partitionBy("document_id")))


def q26_context_window(spark: SparkSession, d: str) -> DataFrame:
    hits = C.corpus(spark, d).select("document_id", (F.col("document_id") % 30).cast("int").alias("center"))
    return context.window(C.chunks(spark, d), hits)


def q27_context_by_page(spark: SparkSession, d: str) -> DataFrame:
    hits = C.corpus(spark, d).select("document_id", (F.col("document_id") % 4).cast("int").alias("center_page"))
    return context.by_page(C.chunks(spark, d, paged=True), hits, 4000)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    hits = search.shown(search.top_k(C.vectors(spark, d), C.query_vector(spark, d), 3), _documents(spark, d))
    return answers.ranked_hits(hits).withColumn("center", F.lit(12))


def _context(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return context.hybrid(C.chunks(spark, d, only=hits), hits)


def q28_hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d)


def q29_context_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.budget(C.chunks(spark, d), ["document_id"], 2000)


def q30_context_multi_doc(spark: SparkSession, d: str) -> DataFrame:
    return context.assembled(_context(spark, d))


def q31_rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = context.assembled(_context(spark, d)).withColumn("m", prompts.messages(F.col("context"), QUESTION))
    return rows.select(F.explode("m").alias("m")).select("m.role", "m.content")


def q32_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = store.without(C.corpus(spark, d).drop("text"), document_id=5)
    return store.without(rows, path="\\src7\\en\\doc_7.txt").select("document_id", "path")


def q33_prune_missing(spark: SparkSession, d: str) -> DataFrame:
    present = C.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return store.pruned(C.corpus(spark, d), present, "document_id").select("document_id", "path")


def _page_files(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?://[^/]+", "").alias("path"), F.length("html").cast("long").alias("length"))


def q34_scan_stats(spark: SparkSession, d: str) -> DataFrame:
    return files.scan_stats(_page_files(spark, d), 3000)


def q35_exclude_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = C.corpus(spark, d).select("document_id", "path")
    return files.without_paths(rows, rows.filter("document_id % 3 = 0").select("path"))


def q36_tiers(spark: SparkSession, d: str) -> DataFrame:
    machines = spark.range(0, 40000, 500).select(F.col("id").cast("int").alias("ram_mb"))
    rows = tiers.model_for(machines)
    return rows.select(
        "ram_mb", "model", "size_label", tiers.batch_size(F.col("ram_mb")).alias("batch_size"), tiers.batch_sleep(F.col("ram_mb")).cast("double").alias("sleep"),
        tiers.workers((F.col("ram_mb") / 1000).cast("int") + 1, F.lit(12), F.col("ram_mb")).alias("workers"), scalars.clamp_top_k((F.col("ram_mb") / 500).cast("int")).alias("top_k"),
    )


def q37_l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "embeddings").select("vec_id", F.transform(vectors.doubles(F.col("embedding")), lambda x: x * (F.col("label") + 1)).alias("v"))
    return rows.select("vec_id", F.posexplode(vectors.l2_normalized(F.col("v"))).alias("place", "x")).withColumn("x", F.round("x", 6))


def q38_metadata_json(spark: SparkSession, d: str) -> DataFrame:
    props = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, F.lit(None).cast("string")).when(F.col("event_id") % 10 == 2, F.concat(F.lit('{"page": '), (F.col("event_id") % 7).cast("string"), F.lit("}"))).otherwise(F.col("props"))
    return C.table(spark, d, "events").select("event_id", scalars.metadata_of(props).alias("metadata"), F.coalesce(scalars.metadata_page(props), F.lit(0)).alias("page"), F.get_json_object(scalars.metadata_of(props), "$.k").cast("long").alias("k"))


PATHS = [r"a\b\c", "/x/y/", "/x/y///", "/", "C:/", "C:\\", "C:\\x\\", "", "x", "x/", "//", "/Ä/b c/"]


def q39_path_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(PATHS)], "k int, path string")
    return rows.select("k", scalars.normalize_path(F.col("path")).alias("path"), scalars.normalize_folder(F.col("path")).alias("folder"))


def q40_embed_text(spark: SparkSession, d: str) -> DataFrame:
    rows = indexer.embedded(C.corpus(spark, d).select("document_id", "text"), indexer.hashing_encoder)
    return rows.select("document_id", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def _working_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one for a local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = f"file://{tempfile.mkdtemp(prefix='folioscan-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def q41_incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a stream into a new store; what the store has then."""
    folder = _working_folder(spark)
    st = store.Store(spark, f"{folder}/store")
    schema = C.table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    rows = C.as_corpus(stream).withColumn("mtime", F.lit(0.0))

    def chunks_of(batch: DataFrame) -> DataFrame:
        cut = chunking.chunked(batch, "path", C.CHUNK_CHARS, C.OVERLAP)
        return indexer.embedded(cut.withColumn("metadata", F.to_json(F.struct("page"))), indexer.hashing_encoder)

    upsert_stream(st, rows, chunks_of, f"{folder}/checkpoint").awaitTermination()
    counts = st.chunks().groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return st.documents().join(counts, F.col("id") == F.col("document_id"), "left").select("path", "title", "sha256", "size", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))


def q42_page_or_window(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every other document have pages; the others fall back to the window."""
    rows = C.chunks(spark, d, paged=True).withColumn("page", F.when(F.col("document_id") % 2 == 0, F.col("page")))
    hits = C.corpus(spark, d).select("document_id", F.lit(4).alias("center"))
    return context.page_or_window(rows, hits, 4000)


def q43_page_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt for a clicked chunk: its page's context within a budget, in the wording for one document."""
    few = C.chunks(spark, d, paged=True, only=F.col("document_id") == 4)
    around = context.page_or_window(few, few.select("document_id").distinct().withColumn("center", F.lit(2)), 2000)
    text = context.joined(context.budget(around, ["document_id"], 2000), ["document_id"])
    return text.select("document_id", F.explode(prompts.messages(F.col("context"), QUESTION, page=True)).alias("m")).select("document_id", "m.role", "m.content")


def q44_joined_chunks(spark: SparkSession, d: str) -> DataFrame:
    return context.joined(context.budget(C.chunks(spark, d), ["document_id"], 3000), ["document_id"])


def q45_ask(spark: SparkSession, d: str) -> DataFrame:
    """End to end, with a function in the model's place that says how long its prompt is."""
    hits = search.top_k(C.vectors(spark, d), C.query_vector(spark, d), 3)
    chunks = search.shown(hits, _documents(spark, d))
    answer = answers.ask(chunks, QUESTION, C.query_vector(spark, d), lambda m: f"{m[0]['role']} {len(m[0]['content'])} {m[1]['role']} {len(m[1]['content'])}")
    return answer.select("answer", "context", F.array_join(F.transform("sources", lambda x: F.concat(x["path"], F.lit("#"), x["chunk_index"].cast("string"))), ",").alias("sources"))


def q46_scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return files.scan_totals(_page_files(spark, d))


def q47_large_files(spark: SparkSession, d: str) -> DataFrame:
    return files.large_files(_page_files(spark, d), 3000).select("name", "path", "size_bytes")


def q48_backends(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    machines = spark.range(0, 240).select(
        n.alias("k"), F.element_at(F.array(*map(F.lit, ["darwin", "linux", "win32"])), (n % 3 + 1).cast("int")).alias("platform"), F.element_at(F.array(*map(F.lit, ["arm64", "x86_64"])), (F.floor(n / 3) % 2 + 1).cast("int")).alias("machine"),
        F.element_at(F.array(F.lit("cuda"), F.lit("rocm"), F.lit("mps"), F.lit(None).cast("string")), (F.floor(n / 6) % 4 + 1).cast("int")).alias("gpu"), F.when(F.floor(n / 24) % 5 == 0, F.array().cast("array<string>")).when(F.floor(n / 24) % 5 == 1, F.array(F.lit("CUDAExecutionProvider"))).when(F.floor(n / 24) % 5 == 2, F.array(F.lit("ROCMExecutionProvider"))).when(F.floor(n / 24) % 5 == 3, F.array(F.lit("CPUExecutionProvider"))).alias("providers"),
        F.when(n % 7 != 0, (n * 100).cast("int")).alias("ram_mb"),
    )
    return tiers.backends(machines).select("k", "backend", "model_file", "device", tiers.gpu_layers(F.col("platform"), F.col("machine"), F.col("gpu")).alias("gpu_layers"), tiers.known_ram(F.col("ram_mb")).alias("ram_mb"))


def q49_hits_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Hits named by path, with other slashes, and one that isn't there."""
    hits = spark.createDataFrame([(1, "\\src3\\nowhere.txt")], "hit_rank int, path string").unionByName(_hits(spark, d).select((F.col("hit_rank") + 1).alias("hit_rank"), F.replace("path", F.lit("/"), F.lit("\\")).alias("path")))
    return search.located(hits, C.corpus(spark, d)).select("hit_rank", "path", "document_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").startswith("q") and f.__name__[1:3].isdigit()}
