"""The corpus tables as an index: documents with paths and hashes, one vector a document, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.chunking import chunked

CHUNK_CHARS, OVERLAP = 500, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_corpus(documents: DataFrame) -> DataFrame:
    """document_id, path, title, sha256, size, text."""
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(
        F.col("doc_id").alias("document_id"), path.alias("path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "text"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_corpus(table(spark, sf_dir, "documents"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, chunk_index, embedding: one vector a document that is there. What else a hit shows is joined to the hits."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    return rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")


def vectors_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors() with path, which folder filters need before scores."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    return rows.join(corpus(spark, sf_dir).select("document_id", "path"), "document_id")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").head()
    return list(row["embedding"]) if row else []


def chunks(spark: SparkSession, sf_dir: str, paged: bool = False, only: DataFrame | Column | None = None) -> DataFrame:
    """document_id, chunk_index, text, page. only: the documents to be cut, as a condition or a few rows of document_id."""
    docs = corpus(spark, sf_dir)
    if isinstance(only, Column):
        docs = docs.filter(only)
    elif only is not None:
        docs = docs.join(only.select("document_id").distinct(), "document_id", "left_semi")
    return chunked(docs, "document_id", CHUNK_CHARS, OVERLAP, paged)
