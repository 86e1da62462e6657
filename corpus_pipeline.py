"""A corpus made ready for training: STAGES in order, each written as Parquet and read as the next one's documents.

Stages but the last return the columns of documents. Each works on all that its predecessor kept.
The PII and packing stages have no SQL twin, so ORACLE_SQL is None; tests compare run() with a
brute-force version.

Null and empty texts have too few words, so the first stage rejects them; a stage run by itself keeps
them. Documents with a null id are judged by the quality rules, are never near copies or leaks of
anything, and stay. Repeated rows: the second stage keeps one. Rows that share an id with different
texts are documents of their own. Ties: of near copies the smallest id stays, and a row whose id is
shared comes after all that have their own. Long texts: whole. Tables without rows: no rows; without
labels or benchmark, the base rule alone and no leaks. Further columns are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, near_dedup, packing, pii, quality
from folioscan.llm.common import dropped, met, table, written
from folioscan.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects. The rules are learnt on the labelled ones."""
    chosen = quality.sampled(table(spark, sf_dir, "labels"))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rules = quality.learn(quality.with_counts(labelled).drop("text"), chosen)
    return quality.judged(quality.with_counts(docs), rules).filter("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and of each repeated row: the smallest id."""
    shared = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "shared")
    rows = docs.select(F.col("doc_id").alias("_id"), *COLUMNS)
    if not shared.isEmpty():
        # Where rows share an id, all are numbered for as long as they are compared: in order of their ids, those that share one last.
        own = met(docs, shared, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(F.lit(True).alias("_shared"), *COLUMNS)
        rows = met(docs, shared, "doc_id", "left_anti").select(F.lit(False).alias("_shared"), *COLUMNS).unionByName(own)
        rows = rows.repartitionByRange("_shared", "doc_id").sortWithinPartitions("_shared", "doc_id")
        rows = written(rows.select(F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("_id"), *COLUMNS), "numbered")
    found = near_dedup.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"))
    return met(rows, found.filter("NOT kept").select(F.col("doc_id").alias("_id")), "_id", "left_anti").select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaked = decontaminate.leaked_documents(docs, table(spark, sf_dir, "benchmark"))
    return met(docs, leaked.filter("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and revealing terms generalised or removed."""
    return pii.sanitise(docs.select(COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = None
    for name, stage in STAGES:
        docs = written(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs


ORACLE_SQL: str | None = None
