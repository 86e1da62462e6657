"""Statistics of a corpus's words, and a reranker that weighs words by them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In how many texts a word is and how often in all; the empty word stands for the texts and for all words.
TERMS = "word string, chunks bigint, occurrences bigint"


def words(text: Column) -> Column:
    """The words of a text in order: lower case, divided by white space. Null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def summed(terms: DataFrame) -> DataFrame:
    """One row a word from several; words that no text has any more are left out."""
    return terms.groupBy("word").agg(F.sum("chunks").alias("chunks"), F.sum("occurrences").alias("occurrences")).filter("chunks != 0 OR occurrences != 0")


def term_statistics(texts: DataFrame) -> DataFrame:
    """TERMS of the texts (text). No texts: no rows.

    A text's words are sorted, and each is compared with the one before it, so texts aren't shuffled and
    no id is needed; equal words of a partition are added up before they move.
    """
    split = texts.select(F.array_sort(words(F.col("text"))).alias("ws"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))))
    each = split.select(F.explode(F.arrays_zip("ws", before.alias("before"))).alias("w")).filter("w.ws IS NOT NULL")
    first = F.coalesce(F.col("w.ws") != F.col("w.before"), F.lit(True))
    rows = each.select(F.col("w.ws").alias("word"), first.cast("long").alias("chunks"), F.lit(1).cast("long").alias("occurrences"))
    whole = split.select(F.lit("").alias("word"), F.lit(1).cast("long").alias("chunks"), F.size("ws").cast("long").alias("occurrences"))
    return summed(rows.unionByName(whole))


def bm25_logit(question: str, terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> Callable[[Column], Column]:
    """A logit for search.reranked: Okapi BM25 of the text for the question's distinct words.

    Of terms only the question's words come to the driver, at most one row for each. A word that no text
    has weighs as one that is in none of them; without statistics all texts get 0.
    """
    asked = sorted(set(question.lower().split()))
    known = {r["word"]: (r["chunks"], r["occurrences"]) for r in terms.filter(F.col("word").isin([*asked, ""])).collect()}
    n, length = known.get("", (0, 0))
    if not n or not length:
        return lambda text: F.lit(0.0)
    weight = {w: math.log(1 + (n - df + 0.5) / (df + 0.5)) for w in asked for df in [known.get(w, (0, 0))[0]]}

    def logit(text: Column) -> Column:
        ws = words(text)
        norm = k1 * (1 - b + b * F.size(ws) / (length / n))
        total = F.lit(0.0)
        for w in asked:
            tf = F.size(F.filter(ws, F.lit(w).eqNullSafe)).cast("double")
            total = total + weight[w] * tf * (k1 + 1) / (tf + norm)
        return total

    return logit
