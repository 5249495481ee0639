"""Joining the results of chunks. The tree of any fan-in gives what one grouping gives, since each rule is associative over ordered input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as t

FAN_IN, MIN_FAN_IN = 8, 2


def check_fan_in(n: int) -> int:
    if n < MIN_FAN_IN:
        raise ValueError(f"fan-in must be at least {MIN_FAN_IN}")
    return n


def in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy("pos")


def union_blocks(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def last_text(value: Column, pos: Column) -> Column:
    """Last value that isn't null or empty."""
    return F.max_by(F.when(value != "", value), F.when(value != "", pos))


def reduce_items(items: DataFrame) -> DataFrame:
    """items: (project, field, pos, text, status, confidence, blocks and, if there are, reason, date, previous), pos in chunk order.

    One row for each (project, field, extraction key): first position, last text, union of blocks, highest confidence;
    tasks take the last status, facts are disputed if ever disputed, else superseded if ever, else as first seen; reason,
    date and previous are the last that aren't empty. Plain strings, which have no confidence, yield to any other item of
    the key; among themselves the first stays.
    """
    plain = F.col("confidence").isNull()
    bare = items.withColumn("key", t.collapse(F.col("text"))).groupBy("project", "field", "key").agg(F.min("pos").alias("_at"), (F.max(F.when(plain, 0).otherwise(1)) == 1).alias("_rich"), F.min_by("text", "pos").alias("_first"))
    items = items.withColumn("key", t.collapse(F.col("text"))).join(bare, ["project", "field", "key"]).where(~(plain & F.col("_rich")))
    more = [c for c in ("reason", "date", "previous") if c in items.columns]
    x = items.where("key <> ''").withColumn("rank", t.confidence_rank(F.col("confidence")))
    task = F.col("field") == "tasks"
    ever = lambda s: F.max(F.when(F.col("status") == s, 1).otherwise(0)) == 1
    g = x.groupBy("project", "field", "key").agg(
        F.first("_at").alias("_at"), F.first("_rich").alias("_rich"), F.first("_first").alias("_first"), last_text(F.col("text"), F.col("pos")).alias("text"), union_blocks("blocks").alias("blocks"),
        F.min_by("confidence", F.struct(-F.col("rank"), "pos")).alias("confidence"), *[last_text(F.col(c), F.col("pos")).alias(c) for c in more], last_text(F.col("status"), F.col("pos")).alias("last"),
        ever("disputed").alias("disputed"), ever("superseded").alias("superseded"), F.min_by("status", "pos").alias("first"))
    status = F.when(task, F.col("last")).when(F.col("disputed"), "disputed").when(F.col("superseded"), "superseded").otherwise(F.coalesce("first", F.lit("active")))
    return g.select("project", "field", "key", F.col("_at").alias("pos"), F.when(F.col("_rich"), F.col("text")).otherwise(F.col("_first")).alias("text"), status.alias("status"), "confidence", "blocks", *more)


def reduce_scalars(scalars: DataFrame) -> DataFrame:
    """(project, pos, value): the last non-empty reliable value, else the last that needs review, else ''."""
    v = F.col("value")
    reliable = (v != "") & ~v.startswith(t.NEEDS_REVIEW)
    best = F.coalesce(F.max_by(F.when(reliable, v), F.when(reliable, F.col("pos"))), last_text(v, F.col("pos")), F.lit(""))
    return scalars.groupBy("project").agg(best.alias("value"))


def reduce_candidates(c: DataFrame) -> DataFrame:
    """(project, chunk, display_name, aliases, message_numbers, confidence): sorted unions, highest confidence, first display name; a candidate of one chunk keeps its lists."""
    rank = t.confidence_rank(F.col("confidence"))
    once = F.count("*") == 1
    both = lambda n: F.when(once, F.first(n)).otherwise(union_blocks(n)).alias(n)
    return c.groupBy("project").agg(F.min_by("display_name", "chunk").alias("display_name"), both("aliases"), both("message_numbers"), F.min_by("confidence", F.struct(-rank, "chunk")).alias("confidence"))


def names_from_list(names: DataFrame, ascii_only: bool = False, keep_bad: bool = False) -> DataFrame:
    """(id, names): a comma-separated list as candidates; blanks go, the first of equal safe names stays. Names that no file could have go too or, keep_bad, have a null project."""
    x = names.select("id", F.posexplode(F.split("names", ",")).alias("pos", "raw")).withColumn("raw", t.strip(F.col("raw"))).where("raw <> ''")
    x = x.withColumn("project", t.safe_name(F.col("raw"), ascii_only))
    if not keep_bad:
        x = x.where("project IS NOT NULL")
    w = Window.partitionBy("id", "project").orderBy("pos")
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "project", "pos", F.col("raw").alias("display_name"), F.lit("HIGH").alias("confidence"))


def tally(parts: DataFrame) -> DataFrame:
    return parts.groupBy("status").agg(F.count("*").alias("n"))
