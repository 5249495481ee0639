"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Largest inner product becomes nearest distance: a candidate x of norm at most M gets one more component
sqrt(M^2 - |x|^2), a query is scaled to norm M and gets 0; then |q - x|^2 = 2 M^2 - 2 M <q, x> / |q|. Gaussian
projections to DIMS dimensions are 2-stable: the squared projected distance over the squared distance follows the
chi-square law with DIMS degrees of freedom. Each block's projected rows, all of them, are held in a kd-tree. A query
takes projected neighbours nearest first, leaf by leaf, verifies them with the exact double-precision measure and
stops when the chance that an unseen row within its kth verified distance would have been projected beyond the
radius seen so far falls below 1 - CONFIDENCE.

Ties in the measure go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors are compared only with those of as many components. Rows that share one vector in great number
are cut, exactly, to those that can be in an answer: the k + 1 smallest ids of a vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

DIMS = 8
CONFIDENCE = 0.95
LEAF = 64


def chi2_cdf(x: float, m: int) -> float:
    """P(chi-square with even m degrees of freedom <= x), in closed form."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 50
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree as its leaves: rows ordered so that each leaf is a slice, and the leaves' bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        slices, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                slices.append((a, b))
                continue
            own = points[order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a + mid, b), (a, a + mid)]
        self.order, self.slices = order, np.array(slices)
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in slices])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in slices])

    def squared_to_leaves(self, p: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        return (gap * gap).sum(axis=1)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, dims: int = DIMS, confidence: float = CONFIDENCE) -> list[tuple]:
    """(query id, id, inner product) of the k nearest found in one block."""
    norm2 = np.einsum("ij,ij->i", x, x)
    top = float(norm2.max())
    lift = np.sqrt(np.maximum(top - norm2, 0))
    proj = np.random.default_rng(20).standard_normal((x.shape[1] + 1, dims))
    points = x @ proj[:-1] + lift[:, None] * proj[-1]
    tree = Tree(points)
    x, ids, q_norm = x[tree.order], ids[tree.order], np.sqrt(np.einsum("ij,ij->i", q, q))
    q_points = (q / q_norm[:, None] * math.sqrt(top)) @ proj[:-1]
    limit = chi2_quantile(confidence, dims)
    out = []
    for i in range(len(q)):
        far = tree.squared_to_leaves(q_points[i])
        by = np.argsort(far, kind="stable")
        far = far[by]
        scores, places, done, step = np.zeros(0), np.zeros(0, np.int64), 0, 4
        kth = -math.inf
        while done < len(by):
            d2 = max(0.0, 2 * top - 2 * math.sqrt(top) * kth / q_norm[i]) if kth > -math.inf else math.inf
            if len(scores) >= k and far[done] > limit * d2:  # all within this radius are seen: the chi-square test holds
                break
            upto = done + step if len(scores) < k else max(done + 1, min(done + step, int(np.searchsorted(far, limit * d2, side="right"))))
            own = tree.slices[by[done:upto]]
            at = np.concatenate([np.arange(a, b) for a, b in own])
            at = at[ids[at] != q_ids[i]]
            scores, places = np.concatenate([scores, x[at] @ q[i]]), np.concatenate([places, at])
            if len(scores) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= least - abs(least) * 1e-12  # ties stay until ids decide
                scores, places = scores[keep], places[keep]
                kth = float(least)
            elif len(scores) == k:
                kth = float(scores.min())
            done, step = min(upto, len(by)), step * 2
        exact = np.array([math.fsum(a) for a in (x[places] * q[i])]) if len(places) else scores
        best = np.lexsort((ids[places], -exact))[:k]
        out += zip([q_ids[i]] * len(best), ids[places][best].tolist(), exact[best].tolist())
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    v = F.col("vec")
    return (
        df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    )


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, id, score): for each query the k candidates of df with the largest inner product found, its own row left out."""
    q, all_rows = usable(queries, id_col, vec_col), usable(df, id_col, vec_col)
    same = Window.partitionBy("vec").orderBy("id")
    c = all_rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        b_len, a_len = b["vec"].map(len), a["vec"].map(len)
        for n in a_len.unique():
            mine, own = b[b_len == n], a[a_len == n]
            if len(mine):
                out += search_block(own["id"].to_numpy(), np.stack(own["vec"]), mine["id"].to_numpy(), np.stack(mine["vec"]), k, dims, confidence)
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    return blocks.search(q, c, k, "vec", one, "double", True).select("query_id", "rank", F.col("id").alias(id_col), "score")
