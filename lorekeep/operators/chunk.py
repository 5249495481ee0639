"""Bounded chunks of a history: split what is too long, then pack greedily in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as t

MIN_CHARS, DEFAULT_CHARS, RESERVE = 1_000, 50_000, 128


def check(max_chars: int) -> int:
    if max_chars < MIN_CHARS:
        raise ValueError(f"chunks need at least {MIN_CHARS} characters")
    return max_chars


def split_text(text: Column, limit: int) -> Column:
    """array<string>: pieces of at most limit characters, cut at the last blank or line break before the limit, or hard if that lies before its middle."""
    start = F.struct(t.strip(text).alias("rest"), F.array().cast("array<string>").alias("parts"))
    turns = F.sequence(F.lit(0), F.floor(F.length(text) / (limit // 2)).cast("int") + 1)

    def turn(acc: Column, _: Column) -> Column:
        head = F.substring(acc["rest"], 1, limit)
        place = F.length(head) - F.least(*[F.when(F.locate(s, F.reverse(head)) > 0, F.locate(s, F.reverse(head))).otherwise(limit + 1) for s in ("\n", " ")])  # of the last blank, from 0
        at = F.when(place < limit // 2, limit).otherwise(place)
        part = t.strip(F.substring(acc["rest"], F.lit(1), at))
        more = F.struct(t.strip(F.substring(acc["rest"], at + 1, F.length(acc["rest"]))).alias("rest"), F.when(part != "", F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))
        return F.when(F.length(acc["rest"]) > limit, more).otherwise(acc)

    return F.aggregate(turns, start, turn, lambda a: F.when(a["rest"] != "", F.concat(a["parts"], F.array(a["rest"]))).otherwise(a["parts"]))


def pieces(messages: DataFrame, max_chars: int = DEFAULT_CHARS) -> DataFrame:
    """Messages, those over max_chars split; adds part (from 0) and size."""
    size = t.message_size(F.col("text"), F.col("role"), F.col("date"))
    text = F.when(size <= check(max_chars), F.array("text")).otherwise(split_text(F.col("text"), max_chars - RESERVE))
    x = messages.select("history_id", "number", "role", "date", F.posexplode(text).alias("part", "text"))
    return x.withColumn("size", t.message_size(F.col("text"), F.col("role"), F.col("date")))


def pack(parts: DataFrame, max_chars: int = DEFAULT_CHARS) -> DataFrame:
    """Adds chunk (from 0): a new chunk begins when a chunk isn't empty and would pass max_chars.

    The running sum with reset is a fold over one history's sizes. Numbers only are gathered by history, and the fold
    keeps just the places where chunks begin; a piece's chunk is the count of these up to it.
    """
    sizes = parts.groupBy("history_id").agg(F.sort_array(F.collect_list(F.struct("number", "part", "size"))).alias("rows"))
    start = F.struct(F.lit(1 << 30).cast("long").alias("held"), F.array().cast("array<struct<number:int,part:int>>").alias("begins"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["held"] + x["size"] > check(max_chars)
        here = F.array(F.struct(x["number"].cast("int").alias("number"), x["part"].cast("int").alias("part")))
        return F.struct(F.when(new, x["size"].cast("long")).otherwise(acc["held"] + x["size"]).alias("held"), F.when(new, F.concat(acc["begins"], here)).otherwise(acc["begins"]).alias("begins"))

    begins = sizes.select("history_id", F.explode(F.aggregate("rows", start, step, lambda a: a["begins"])).alias("b")).select("history_id", "b.number", "b.part", F.lit(1).alias("_begins"))
    upto = Window.partitionBy("history_id").orderBy("number", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = parts.join(begins, ["history_id", "number", "part"], "left")
    return marked.select("history_id", "number", "part", "size", "role", "date", "text", (F.count("_begins").over(upto) - 1).cast("int").alias("chunk"))
