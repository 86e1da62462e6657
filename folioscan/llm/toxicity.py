"""Operator 1, toxicity by weak supervision.

1. Lexicon: from labelled documents that aren't held out (crc32(doc_id) mod 5 != 0; at most FIT_ROWS
   of them, an expected number, chosen by hash) terms, that is words and word beginnings of 4 to 6
   letters, are counted by document and label. Terms that toxic documents use much more often are
   dealt by rank to LEXICONS lexicons of words and as many of beginnings.
2. Voters: each lexicon votes toxic where enough of its terms occur; two counting voters vote toxic
   from several lexicon words, or beginnings, on, and not toxic where there is none; pattern voters
   look at shouting and exclamation. A voter that sees nothing abstains. They vote on the labelled
   rows and on others that aren't held out, whose labels nobody knows (at most FIT_ROWS, an expected
   number, chosen by hash).
3. Label model: votes are generated from a hidden label. Expectation maximisation estimates each
   voter's accuracy (its votes' probabilities given the label) and the class balance; correlations
   of voters given the label are estimated with it, and correlated voters share their weight, so
   voters that see the same thing don't count twice.
4. A logistic regression over terms learns the posterior labels and scores every whole text. It sees
   at most FEATURES terms, which is what is broadcast. Its offset is set so that 0.5 divides the
   labelled rows best; the order of scores is the posteriors' work.

Words are runs of letters, in lower case. Null and empty texts get the score of a document without
terms. Long texts are scored whole, one at a time. Null ids are scored and never learnt from;
repeated rows are scored each, and learnt from each; of contradicting labels of an id the toxic one
holds. Ties between terms go to the first by name. No rows: no rows. Without labels of both kinds,
all scores are 0. labels, lang, source and doc_id aren't inputs of a score; further columns don't
matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, small_batches, text_of, written

if TYPE_CHECKING:
    import numpy as np

FIT_ROWS, FEATURES, LEXICON_TERMS, LEXICONS = 30_000, 6_000, 2_000, 4
#: A lexicon of words, and one of beginnings, votes from so many of its terms on.
WORD_HITS, BEGINNING_HITS = 1, 1
#: The counting voters vote toxic from so many lexicon words, and beginnings, on.
SEVERAL_WORDS, SEVERAL_BEGINNINGS = 2, 3
#: How sure a term must be: its toxic documents less their root are this share of all it occurs in.
LEXICON_SHARE, FEATURE_SHARE = 0.5, 0.25
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Words, and beginnings of longer words with a mark in front."""
    words = set(WORD.findall(text.lower()))
    return words | {f"^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Lexicons:
    place: dict[str, int]  # term: number of its lexicon; words' lexicons come first

    def votes(self, text: str) -> list[int]:
        """1 toxic, -1 not, 0 abstains, for each voter."""
        terms = terms_of(text)
        hits = Counter(self.place[t] for t in terms if t in self.place)
        found = sum(n for k, n in hits.items() if k < LEXICONS)
        started = sum(n for k, n in hits.items() if k >= LEXICONS)
        letters = sum(map(str.isalpha, text)) or 1
        upper = sum(map(str.isupper, text)) / letters
        out = [1 if hits[k] >= (WORD_HITS if k < LEXICONS else BEGINNING_HITS) else 0 for k in range(2 * LEXICONS)]
        out.append(1 if found >= SEVERAL_WORDS else 0 if found else -1)
        out.append(1 if started >= SEVERAL_BEGINNINGS else 0 if started else -1)
        out.append(1 if text.count("!") > 0.02 * len(text) and found else 0)
        out.append(1 if upper > 0.5 and found else 0)
        return out


@dataclass
class LabelModel:
    """P(vote of j | label) as table[j, label, vote + 1], the balance, and each voter's weight."""

    table: np.ndarray
    balance: float
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        import numpy as np

        logs = np.log(self.table)
        j = np.arange(votes.shape[1])
        odds = (logs[j, 1, votes + 1] - logs[j, 0, votes + 1]) * self.weight
        return 1 / (1 + np.exp(-(odds.sum(1) + np.log(self.balance / (1 - self.balance)))))


def fit_label_model(votes: np.ndarray, balance: float, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over votes (rows by voters); balance starts the share of toxic."""
    import numpy as np

    n, m = votes.shape
    p = np.clip(0.5 + votes.sum(1) / (2.0 * max(1, m // 4)), 0.02, 0.98)
    model = None
    for _ in range(rounds):
        table = np.empty((m, 2, 3))
        for label, w in ((0, 1 - p), (1, p)):
            for v in (-1, 0, 1):
                table[:, label, v + 1] = (w[:, None] * (votes == v)).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        share = float(np.clip(p.mean(), 0.5 * balance, min(0.5, 2 * balance)))
        # Correlations given the label, weighted by the posterior.
        correlation = np.zeros((m, m))
        for w in (1 - p, p):
            mean = (w[:, None] * votes).sum(0) / max(w.sum(), 1e-9)
            centred = (votes - mean) * np.sqrt(w)[:, None]
            cov = centred.T @ centred
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation += w.mean() * cov / np.outer(scale, scale)
        others = np.clip(correlation - np.diag(np.diag(correlation)), 0, 1)
        model = LabelModel(table, share, 1 / (1 + (others * (others > 0.2)).sum(1)), correlation)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    assert model is not None
    return model


def fit_linear(rows: list[np.ndarray], p: np.ndarray, width: int, steps: int = 400, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; rows hold the places of each document's terms."""
    import numpy as np

    n = len(rows)
    size = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), size)
    w, b = np.zeros(width), float(np.log(p.mean() / (1 - p.mean())))
    speed, speed_b, rate = np.zeros(width), 0.0, 0.5
    for _ in range(steps):
        ahead, ahead_b = w + 0.9 * speed, b + 0.9 * speed_b
        error = 1 / (1 + np.exp(-(np.bincount(doc, weights=ahead[flat], minlength=n) + ahead_b))) - p
        grad = np.bincount(flat, weights=error[doc], minlength=width) / n + ridge * ahead / n
        speed, speed_b = 0.9 * speed - rate * grad, 0.9 * speed_b - rate * float(error.mean())
        w, b = w + speed, b + speed_b
    return w, b


def cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where to divide scores z so that the toxic side agrees best (by F1) with labels y; midway between two scores."""
    import numpy as np

    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # equal scores aren't divided
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


@dataclass
class Toxicity:
    weight: dict[str, float]
    bias: float
    label_model: LabelModel

    def score(self, text: str) -> float:
        import math

        found = [self.weight[t] for t in terms_of(text) if t in self.weight]
        z = self.bias + sum(found)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity | None:
    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(remainder(F.col("doc_id").cast("long")) != 0)
    total = known.count()
    if not total:
        return None
    share = min(1.0, FIT_ROWS / total)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share))
    doc_id = F.col("doc_id").cast("long")
    unlabelled = doc_id.isNotNull() & (remainder(doc_id) != 0) & (F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / max(1, docs.count()))))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id", "left")  # both bounded by FIT_ROWS
    rows = written(texts.filter(F.col("toxic").isNotNull() | unlabelled).select("doc_id", "text", "toxic"), "voted")

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic].update(terms_of(text))
                n[toxic][""] += 1
        terms = list(n[0].keys() | n[1].keys())
        for a in range(0, len(terms), 50_000):
            part = terms[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"term": part, "neg": [n[0][t] for t in part], "pos": [n[1][t] for t in part]})

    counts = rows.filter("toxic IS NOT NULL").select("text", "toxic").mapInArrow(counted, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).filter("neg + pos >= 4")
    counts = written(counts, "terms")
    whole = counts.filter("term = ''").head()
    if whole is None or not whole["neg"] or not whole["pos"]:
        return None
    pos, neg = whole["pos"], whole["neg"]
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    scored = counts.filter("term != ''").withColumn("odds", odds).withColumn("gain", F.abs("odds") * F.greatest("pos", F.col("neg") * (pos / neg)))

    def sure(least: float) -> Column:
        return (F.col("pos") >= 4) & (F.col("pos") - F.sqrt("pos") >= least * (F.col("pos") + F.col("neg")))

    kinds = {}
    for kind, starts in ((0, False), (1, True)):
        best = scored.filter((F.col("term").startswith("^") == starts) & sure(LEXICON_SHARE)).orderBy(F.desc("gain"), "term").limit(LEXICON_TERMS).collect()
        kinds |= {r["term"]: kind * LEXICONS + k % LEXICONS for k, r in enumerate(best)}
    features = {r["term"]: k for k, r in enumerate(scored.filter(sure(FEATURE_SHARE)).orderBy(F.desc("gain"), "term").limit(FEATURES).collect())}
    lexicons = Lexicons(kinds)
    shared = spark.sparkContext.broadcast((lexicons, features))

    def seen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lexicons, features = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"votes": pa.array([lexicons.votes(t) for t in texts], pa.list_(pa.int32())), "places": pa.array([sorted(features[x] for x in terms_of(t) if x in features) for t in texts], pa.list_(pa.int32())), "toxic": batch.column(1)})

    learnt = rows.select("text", "toxic").mapInArrow(seen, "votes array<int>, places array<int>, toxic int").toArrow()
    votes = np.array(learnt.column("votes").to_pylist(), dtype=np.int64)
    model = fit_label_model(votes, pos / (pos + neg))
    p = model.posterior(votes)
    lists = learnt.column("places").combine_chunks()
    edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    places = [flat[a:b].astype(np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    weight, bias = fit_linear(places, np.clip(p, 1e-3, 1 - 1e-3), len(features))
    z = np.array([weight[k].sum() for k in places]) + bias
    toxic = learnt.column("toxic").to_pandas().to_numpy(np.float64)
    labelled = ~np.isnan(toxic)
    offset = cut(z[labelled], toxic[labelled])
    return Toxicity({t: float(weight[k]) for t, k in features.items()}, bias - offset, model)


def score(docs: DataFrame, model: Toxicity | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (remainder(doc_id) == 0).alias("held_out"), text_of().alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = [shared.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
