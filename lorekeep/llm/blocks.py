"""Searching all rows for a stated set of queries, block against block.

Candidates go to blocks of about block_rows rows by a hash of their id, queries to chunks of about chunk_rows. Each
pair of a block and a chunk is one group, so no group grows with the data; a group returns its k best for each of its
queries, and a window with a pushed-down rank limit merges them. Block and chunk numbers follow from two counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
CHUNK_ROWS = 4_096
MOST_TASKS = 100_000


def search(queries: DataFrame, candidates: DataFrame, k: int, payload: str, one: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
           score_type: str, descending: bool, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """queries and candidates: (id, payload). one(queries, candidates) -> (query_id, id, score, own columns). Best k of each query over all blocks, ties to the smaller id."""
    n_blocks = max(1, math.ceil(candidates.count() / block_rows))
    n_chunks = max(1, math.ceil(queries.count() / chunk_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    c = candidates.select("id", payload, part(n_blocks, 11).alias("block"), every(n_chunks).alias("chunk"))
    q = queries.select("id", payload, part(n_chunks, 12).alias("chunk"), every(n_blocks).alias("block"))
    id_type = candidates.schema["id"].dataType.simpleString()

    def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return one(a, b)

    # a set number of partitions, as few bytes may be much work
    n = min(n_blocks * n_chunks, MOST_TASKS)
    q, c = q.repartition(n, "block", "chunk"), c.repartition(n, "block", "chunk")
    found = q.groupBy("block", "chunk").cogroup(c.groupBy("block", "chunk")).applyInPandas(group, f"query_id {id_type}, id {id_type}, score {score_type}")
    by = F.col("score").desc() if descending else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
