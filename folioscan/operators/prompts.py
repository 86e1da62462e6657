"""Prompts for question answering, and the seam for a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of prompts and of the answer without hits.
SYSTEM = (
    "You are a helpful assistant that answers questions based on the provided document context. "
    "Use ONLY the information from the context below to answer. "
    "If the context does not contain enough information, say so clearly. "
    "Answer in the same language as the user's question."
)
SYSTEM_PAGE = (
    "You are a helpful assistant that answers questions based on the provided document context. "
    "Use ONLY the information from the context below. "
    "If the context does not contain enough information, say so clearly. "
    "Answer in the same language as the user's question."
)
CLOSING = "Answer based only on the context above:"


def messages(context: Column, question: str, page: bool = False) -> Column:
    """Array of struct(role, content). page: the wording for one document's page."""
    user = F.concat(F.lit("Context:\n"), context, F.lit(f"\n\nQuestion: {question}" + ("" if page else f"\n\n{CLOSING}")))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PAGE if page else SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def answers(prompts, chat: Callable[[list[dict]], str]):  # noqa: ANN001, ANN201  DataFrames
    """prompts with answer, by a function that each worker calls with a list of messages."""

    @F.pandas_udf("string")
    def answer(batch: pd.Series) -> pd.Series:
        return batch.map(lambda m: chat([{"role": x["role"], "content": x["content"]} for x in m]))

    return prompts.withColumn("answer", answer("messages"))
