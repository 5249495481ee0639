"""What the training-data operators share: the shared folder, cutting lineage, small vectorised helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.runtime import cut, discard, ship, shared_dir  # noqa: F401

#: Bytes of text that a Python worker holds as one unit of work.
UNIT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with one more column, and its name: it tells rows apart and stays the same however often and with however many executors they are read.

    It is the id where ids are unique and not null; else rows get a number each, and are written so that it stays.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").count()
    if ids.where("count > 1 OR id IS NULL").limit(1).count():
        return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name
    return docs.withColumn(name, F.col(id_col)), name


def small_batches(df: DataFrame, rows: int = 2048) -> DataFrame:
    """df, with Arrow batches of a bounded number of rows and bytes in this session, unless it has its own setting."""
    conf = ship(df.sparkSession).conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def units(texts: list[str | None], limit: int = UNIT_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of texts that hold about limit characters each; one longer text is a unit of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n + 16
    if start < len(texts):
        yield start, len(texts)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


#: What operators keep in a Python worker between tasks: how to drop it, by operator.
HELD: dict[str, Callable[[], None]] = {}


def begin(operator: str) -> None:
    """A task begins: its worker, which may have served other operators, drops what those keep."""
    for other, drop in HELD.items():
        if other != operator:
            drop()
    give_back()


def give_back() -> None:
    """Return freed memory of a Python worker to the system: Arrow's pool, then the C library's, where it can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own account
        pass
