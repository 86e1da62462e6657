"""Question answering end to end: search, context, prompt, model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators import context, prompts, search
from folioscan.operators.indexer import Encoder, hashing_encoder
from folioscan.operators.store import Store

# Fixed value: the answer where nothing is found.
NOTHING = "No relevant documents found for your query."
Chat = Callable[[list[dict]], str]
ANSWER = "answer string, sources array<struct<path:string,chunk_index:int,score:double>>, context string"


def ranked_hits(hits: DataFrame) -> DataFrame:
    """hit_rank, document_id, path, center of the few rows of one search, in its order."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "document_id", "chunk_index")
    return hits.select(F.row_number().over(order).alias("hit_rank"), "document_id", "path", F.col("chunk_index").alias("center"))


def ask(chunks: DataFrame, question: str, vector: Sequence[float], chat: Chat, k: int = 3, logit: Callable[[Column], Column] | None = None, size: int = 10) -> DataFrame:
    """One row: answer, sources (path, chunk_index, score), context. chunks: document_id, chunk_index, path, text, embedding.

    The search runs once, when this is called: its k hits come to the driver, and the context starts from them.
    """
    spark = chunks.sparkSession
    found = search.search(chunks, vector, k, logit=logit).select("document_id", "path", F.col("chunk_index").cast("int").alias("chunk_index"), "score").collect()
    if not found:
        return spark.createDataFrame([(NOTHING, [], "")], ANSWER)
    hits = spark.createDataFrame([(n, r["document_id"], r["path"], r["chunk_index"]) for n, r in enumerate(found, 1)], "hit_rank int, document_id long, path string, center int")
    text = context.assembled(context.hybrid(chunks.drop("path", "embedding"), hits, size)).withColumn("messages", prompts.messages(F.col("context"), question))
    sources = F.array(*(F.struct(F.lit(r["path"]).alias("path"), F.lit(r["chunk_index"]).alias("chunk_index"), F.lit(r["score"]).alias("score")) for r in found))
    return prompts.answers(text, chat).select("answer", sources.alias("sources"), "context")


def ask_store(st: Store, question: str, chat: Chat, k: int = 3, folders: Sequence[str] | None = None, logit: Callable[[Column], Column] | None = None, encoder: Callable[[], Encoder] = hashing_encoder, size: int = 10) -> DataFrame:
    """ask() over what a store has, or over those of its files that can hold the folders' documents."""
    return ask(st.searchable(folders), question, encoder()([question])[0], chat, k, logit, size)
