"""Exact top-k search of binary codes by incremental multi-index hashing.

A code has one or more words of 64 bits, each cut into SEGMENTS parts. Each block keeps, for every part, its codes grouped
by the part's value. A query looks up all values within radius 0, 1, 2, ... of its own parts. After radius r in every part,
a code not seen differs by more than r bits in each of m parts, so by at least m * (r + 1) in all: the search ends when
the kth verified distance is less than that, or when every code has been seen. No cap is set.

Codes are compared only with codes of as many bits. Ties in distance go to the smaller id. Rows with a null id or code
take no part; an empty table gives no rows. Rows that share one code are cut, exactly, to the k + 1 smallest ids of that
code, which are all that an answer can hold.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import ragged

SEGMENTS = 4
WIDTH = 64 // SEGMENTS


def sign_code(vec: Column) -> Column:
    """struct<width int, bits array<long>>: bit i of the vector's width is 1 if component i is over 0 (as NaN is for Spark); null if vec is null, empty or holds a null."""
    word = lambda w: F.aggregate(
        F.transform(F.slice(vec, w * 64 + 1, F.lit(64)), lambda c, i: F.when(c > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.size(vec), F.lit(1)) / 64).cast("int") - 1), word)
    return F.when(vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda c: c.isNull()), F.struct(F.size(vec).alias("width"), words.alias("bits")))


_MASKS: dict[int, np.ndarray] = {}


def masks(r: int) -> np.ndarray:
    """All part values of weight r."""
    if r not in _MASKS:
        _MASKS[r] = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], np.int64)
    return _MASKS[r]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int) -> list[tuple]:
    """q and codes: a row of words for each code."""
    q, codes = (np.ascontiguousarray(x).view(np.uint64) for x in (q, codes))
    parts = SEGMENTS * codes.shape[1]
    part = lambda x, s: ((x[:, s // SEGMENTS] >> np.uint64(s % SEGMENTS * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
    index = []
    for s in range(parts):
        own = part(codes, s)
        order = np.argsort(own, kind="stable")
        index.append((order, np.searchsorted(own[order], np.arange((1 << WIDTH) + 1))))
    out = []
    seen = np.zeros(len(codes), bool)
    for i in range(len(q)):
        seen[:] = False
        kept_d, kept_at, n_seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for r in range(WIDTH + 1):
            fresh = []
            for s, (order, starts) in enumerate(index):
                values = masks(r) ^ int(part(q[i : i + 1], s)[0])
                a, b = starts[values], starts[values + 1]
                full = b > a
                if full.any():
                    fresh.append(order[ragged(a[full], b[full] - a[full])])
            if fresh:
                at = np.unique(np.concatenate(fresh))
                at = at[~seen[at]]
                seen[at] = True
                n_seen += len(at)
                at = at[ids[at] != q_ids[i]]
                kept_d = np.concatenate([kept_d, np.bitwise_count(codes[at] ^ q[i]).sum(axis=1).astype(np.int64)])
                kept_at = np.concatenate([kept_at, at])
            if n_seen == len(codes) or len(kept_d) >= k and np.partition(kept_d, k - 1)[k - 1] < parts * (r + 1):
                break
        best = np.lexsort((ids[kept_at], kept_d))[:k]
        out += zip([q_ids[i]] * len(best), ids[kept_at][best].tolist(), kept_d[best].tolist())
    return out


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(query_id, rank, id, distance): for each query the k rows of df of least Hamming distance, its own row left out. Codes are longs or as sign_code gives them."""
    def pick(d: DataFrame) -> DataFrame:
        code = F.col(code_col)
        if d.schema[code_col].dataType.typeName() != "struct":
            code = F.when(code.isNotNull(), F.struct(F.lit(64).alias("width"), F.array(code.cast("long")).alias("bits")))
        return d.select(F.col(id_col).alias("id"), code.alias("code")).where("id IS NOT NULL AND code IS NOT NULL")

    same = Window.partitionBy("code").orderBy("id")
    c = pick(df).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        a_width, b_width = (d["code"].map(lambda x: x["width"]).to_numpy() for d in (a, b))
        for width in np.unique(a_width):
            mine, own = a[a_width == width], b[b_width == width]
            if len(own):
                bits = lambda d: np.stack([np.asarray(x["bits"], np.int64) for x in d["code"]])
                out += search_block(mine["id"].to_numpy(), bits(mine), own["id"].to_numpy(), bits(own), k)
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    return blocks.search(pick(queries), c, k, "code", one, "long", False).select("query_id", "rank", F.col("id").alias(id_col), F.col("score").alias("distance"))
