"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's words (lower-cased runs of letters and apostrophes) give unigrams, bigrams and skip-grams over one and two
words; their hashes, in 2^BITS places, are the features, each counted once a text. Training is McMahan's online rule
with a learning rate for each coordinate, L1 and L2; L1 leaves few weights, at most 2^BITS, so the model's broadcast
is bounded (12 bytes a weight). The fit uses at most SAMPLE_ROWS labelled rows, those of least seeded hash of the id,
in hash order, in one task; that bound is this documented parameter.
The L1 strength follows the sample size n: 0.15 sqrt(n), at least 1, at most 12. Scoring covers all rows and whole texts.

Defined results: null texts and texts without words have the bias alone. No labelled rows: score 0.5 for all.
Labels other than 0 and 1 are left out. A doc_id with several labels is toxic if any is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
SAMPLE_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L2 = 0.5, 1.0, 1.0
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=100_000)
def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)


common.HELD["toxicity"] = word_hash.cache_clear


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h >> np.uint64(64 - BITS)


def features(text: str | None) -> np.ndarray:
    """Distinct feature places of the whole text."""
    h = np.array([word_hash(w) for w in _WORD.findall(text.lower())] if text else [], np.uint64)
    out = [_scramble(h)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            out.append(_scramble(h[:-gap] * np.uint64(3 + 2 * gap) + (h[gap:] ^ (h[gap:] >> np.uint64(31))) * _MIX2 + np.uint64(gap)))
    return np.unique(np.concatenate(out).astype(np.int32))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    def __init__(self, l1: float):
        self.l1, self.z, self.n = l1, np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bz = self.bn = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return float(-self.bz / ((BETA + self.bn**0.5) / ALPHA))

    def update(self, f: np.ndarray, y: int) -> None:
        z, n = self.z[f], self.n[f]
        w = self.weights(z, n)
        g = sigmoid(w.sum() + self.bias()) - y
        more = np.sqrt(n + g * g)
        self.z[f] = z + g - (more - np.sqrt(n)) / ALPHA * w
        self.n[f] = n + g * g
        b = self.bias()
        self.bz += g - ((self.bn + g * g) ** 0.5 - self.bn**0.5) / ALPHA * b
        self.bn += g * g


def sample_order(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(5))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """labelled: (id, text, y). Places and values of the weights that aren't zero, and the bias."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("toxicity")
        rows = [(features(t), int(y)) for b in batches for t, y in zip(b["text"], b["y"])]
        model = Ftrl(min(12.0, max(1.0, 0.15 * len(rows) ** 0.5)))
        for _ in range(epochs):
            for f, y in rows:
                model.update(f, y)
        w = model.weights(model.z, model.n)
        at = np.flatnonzero(w)
        rows.clear()
        yield pd.DataFrame({"at": [*at.tolist(), -1], "w": [*w[at].tolist(), model.bias()]})
        word_hash.cache_clear()
        common.give_back()

    # the sample's texts are all that moves: TakeOrdered leaves one partition in this order
    sample = labelled.where("y IN (0, 1)").withColumn("o", sample_order("id")).orderBy("o", "id", "text", "y").limit(sample_rows)
    fitted = common.small_batches(sample.coalesce(1).select("text", "y")).mapInPandas(train, "at long, w double")
    rows = fitted.collect()  # at most 2^BITS weights
    bias = next((r["w"] for r in rows if r["at"] == -1), 0.0)
    rows = sorted((r["at"], r["w"]) for r in rows if r["at"] >= 0)
    return np.array([a for a, _ in rows], np.int32), np.array([w for _, w in rows], np.float32), bias


def scorer(spark, model: tuple[np.ndarray, np.ndarray, float]):
    """A function from a text column to the score column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.begin("toxicity")
        at, w, bias = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = w
        for s in texts:
            out = [sigmoid(float(weights[features(t)].sum(dtype=np.float64)) + bias) for t in s]
            yield pd.Series(out, dtype="float64")
        word_hash.cache_clear()  # the worker lives on, with other stages to come
        common.give_back()

    return score


def labelled_rows(docs: DataFrame, labels: DataFrame, modulus: int | None = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y) of documents that may be learned from: the sample_rows labelled ids of least hash, which is also the bound of what is broadcast."""
    y = labels.select("doc_id", F.col("toxic").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    if modulus:
        y = y.where(common.crc_mod("doc_id", modulus) != held_out)
    y = y.orderBy(sample_order("doc_id"), "doc_id").limit(sample_rows)
    return docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(y), "doc_id").select(F.col("doc_id").alias("id"), "text", "y")


def score_column(docs: DataFrame, labels: DataFrame, text: str = "text", modulus: int | None = 4, **options) -> Column:
    """The score of a text column, by a model fitted on documents and labels."""
    common.small_batches(docs)
    return scorer(docs.sparkSession, fit(labelled_rows(docs, labels, modulus), **options))(F.col(text))
