"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

1. Sizes are word counts; a source is the value of source_col, null being one of its own. Targets share the total by
   weight and stop at MAX_EPOCHS times the source's size, the excess reshared (water filling, solved in closed form).
2. All sources' targets, counted in equal blocks of block_words words, get integer quotas by the highest quotients
   target / (2 i - 1). Documents of a source lie in shards by a seeded hash, about shard_words words each; the source's
   quota goes to groups of GROUP_SHARDS shards and a group's to its shards by the same rule, with their words as votes.
3. A shard lays its documents end to end in seeded order, as a ring. From a seeded word on it takes quota * block_words
   consecutive words, round the ring as often as needed, at most MAX_EPOCHS times.
So whatever the number of rows of one source, windows run over a shard, over the shards of a group, over the groups of a
source (16 million million words a window of 60,000 rows) or over the few sources, and reruns agree.

Ties: quotients by source or shard number, documents by id. Null or empty texts have size 0 and give 0 words. Repeated
rows count each. An empty table gives an empty result. Extra columns are dropped by quotas(), kept by apply().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK_WORDS = 8
SHARD_WORDS = 65_536
GROUP_SHARDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; what isn't one of the six blanks is dropped first, so no word is copied."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    starts = F.regexp_replace(blank, r"[^ ]+", "x")
    return F.coalesce(F.length(F.translate(starts, " ", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target: least(max_epochs * size, level * weight) with the level at which targets add up to the total."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("above", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("open_level", (F.col("total") - F.col("below")) / F.col("above"))
    )
    # sources in the order in which they reach their cap; the level is that of the first that doesn't
    level = F.min(F.when(F.col("open_level") <= F.col("ratio"), F.struct("ratio", "open_level"))).over(everything)["open_level"]
    return ranked.withColumn("level", level).select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def apportion(df: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds out: each row's share of its group's seats by Sainte-Laguë's highest quotients votes / (2 i - 1).

    With divisor votes_total / (seats + m / 2), m the rows of the group, at least `seats` quotients are candidates, and
    with divisor votes_total / (seats - m / 2) at most so many are certain; only those between, at most about 2 m, are ranked.
    """
    g = Window.partitionBy(*group)
    m, total = F.count("*").over(g), F.sum(F.col(votes)).over(g)
    a = df.withColumn("_v", F.col(votes).cast("double")).withColumn("_m", m.cast("double")).withColumn("_t", total.cast("double"))
    at = lambda s: F.when(F.col("_t") > 0, F.floor(F.col("_v") * s / F.col("_t") + 0.5)).otherwise(0).cast("long")
    a = a.withColumn("_sure", at(F.greatest(F.col(seats) - F.col("_m") / 2 - 1, F.lit(0.0))))
    a = a.withColumn("_sure", F.when(F.col("_v") > 0, F.col("_sure")).otherwise(0)).withColumn("_most", F.when(F.col("_v") > 0, at(F.col(seats) + F.col("_m") / 2 + 1)).otherwise(0))
    a = a.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    cand = (
        a.where(F.col("_most") > F.col("_sure"))
        .select(*group, key, "_v", "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_i"))
        .withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_i") - 1)).desc(), key, "_i")))
        .where(F.col("_n") <= F.col("_left"))
        .groupBy(*group, key).agg(F.count("*").alias("_more"))
    )
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, key]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.alias("a").join(cand.alias("b"), cond, "left").select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._sure") + F.coalesce(F.col("b._more"), F.lit(0))).alias(out))


def quotas(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
           seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, first): words taken of each document, and the word of the document (from 0) where taking begins if it isn't whole."""
    # counted once: sizes are small beside texts
    base = common.cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *keep, n_words(F.col(text_col)).alias("size")), "sizes")
    by_source = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    by_source = by_source.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    all_blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    by_source = apportion(by_source.withColumn("all", F.lit(1)).withColumn("blocks", all_blocks), ["all"], "source", "target", "blocks", "source_quota")
    by_source = common.cut(by_source.select("source", "source_size", "target", "shards", "source_quota"), "sources")
    small = by_source.alias("s")
    d = base.alias("d").join(small, F.col("d.source").eqNullSafe(F.col("s.source")))
    shard = F.pmod(F.xxhash64("d.id", F.lit(seed)), F.col("s.shards"))
    d = d.select("d.*", "s.source_size", "s.target", "s.source_quota", shard.alias("shard"))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    shards = common.cut(shards.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS)), "shards")
    in_groups = shards.groupBy("source", "group").agg(F.sum("words").alias("group_words"), F.first("source_quota").alias("source_quota"))
    in_groups = apportion(in_groups, ["source"], "group", "group_words", "source_quota", "group_quota").alias("g")
    shards = shards.alias("s").join(in_groups, F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.group") == F.col("g.group"))).select("s.*", "g.group_quota")
    shards = apportion(shards, ["source", "group"], "shard", "words", "group_quota", "quota").select("source", "shard", "words", "quota")
    start = F.when(F.col("words") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.col("words"))).otherwise(0)
    shards = shards.withColumn("take", F.least(F.col("quota") * block_words, F.col("words") * max_epochs)).withColumn("start", start)
    x = d.alias("d").join(shards.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d.shard") == F.col("h.shard")))
    x = x.select("d.*", "h.words", "h.take", "h.start")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", F.lit(seed + 2)), "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    rest = F.when(F.col("words") > 0, F.col("take") % F.col("words")).otherwise(0)
    x = x.withColumn("turns", F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0)).withColumn("to", F.col("start") + rest)
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    straight = over(F.col("start"), F.least("to", "words"))
    wrapped = over(F.lit(0), F.col("to") - F.col("words"))
    first = F.when(straight > 0, F.greatest(F.col("start") - F.col("begin"), F.lit(0))).otherwise(F.lit(0))
    return x.select("id", "source", *keep, "size", "source_size", "target", (F.col("turns") * F.col("size") + straight + wrapped).cast("long").alias("taken"), first.cast("long").alias("first"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of docs: a document taken t times its size comes t times, and if words are left over, once more cut to these (words of a cut copy keep the blanks after them; the last word of the text has one before its first).

    Documents of which nothing is taken go. The row's text column is replaced in cut copies only.
    """
    cols = docs.columns
    src, own = common.numbered(docs, options.get("id_col", "doc_id"))
    # texts stay out of the windows of quotas() and move once, to the join with what is taken
    q = quotas(src.withColumn("_own", F.col(own)), keep=["_own"], **options).where("taken > 0").select("_own", "size", "taken", "first")
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    left = (F.col("taken") % F.col("size")).cast("int")
    q = q.select("_own", F.struct("size", "first", full.alias("full"), left.alias("left")).alias("_take"))
    text_col = options.get("text_col", "text")
    copies = src.select(F.col(own).alias("_own"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row")).join(q, "_own")
    copies = copies.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_take.full") + F.when(F.col("_take.left") > 0, 1).otherwise(0))))
    words = F.regexp_extract_all(F.col(f"_row.`{text_col}`"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    # from the first taken word on, round to the start where the ring's turn ends inside the document
    first, left = F.col("_take.first").cast("int"), F.col("_take.left")
    end = F.array_join(F.slice(words, first + 1, left), "")
    start = F.array_join(F.slice(words, 1, F.greatest(F.lit(0), left - (F.col("_take.size").cast("int") - first))), "")
    ring = F.concat(end, F.when((start != "") & ~end.rlike(r"[\x20\x09-\x0D]$"), " ").otherwise(""), start)
    text = F.when(F.col("_k") <= F.col("_take.full"), F.col(f"_row.`{text_col}`")).otherwise(ring)
    return copies.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in cols])
