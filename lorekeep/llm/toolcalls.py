"""Chat formatting with tool calls linked to their results.

Messages have the roles user, assistant, tool and system; calls and results are rows of their own. A result is joined
with its call by (conversation, identifier), by hash; a call may name calls it needs. Calls are ordered topologically:
level 0 needs nothing, any other is one over the highest it needs; a cycle, or a needed call that doesn't exist,
leaves level null. Arguments are validated against the tool's schema (names, types, required). Each row becomes one
canonical JSON line: keys in code point order, no blanks, no keys with null; a call's arguments are written alike. Lines aren't gathered per conversation,
so a conversation of any length is spread over tasks; (conversation, level, turn) orders them.

Defined results: several results for a call: the one of the lowest turn, then least text, is linked, others are
orphans. Calls without result have linked = false. Rows with a null conversation or identifier can't be linked.
Arguments that aren't a JSON object, or a tool without a schema, are invalid. Repeated call rows stay repeated.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

def canonical(**fields: Column) -> Column:
    """A JSON object of the fields, keys sorted; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "true"})


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every depth and no blanks; what isn't JSON (or repeats a key) stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def valid(arguments: Column, schema: dict[str, tuple[str, bool]]) -> Column:
    """True if arguments is a JSON object with only the schema's names, the required ones, and the types: {name: (type, required)}."""
    kinds = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN"}
    v = F.try_parse_json(arguments)
    names = F.json_object_keys(arguments)
    ok = v.isNotNull() & names.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, schema)))) == 0)
    for name, (kind, required) in schema.items():
        got = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        there = F.array_contains(names, name)
        ok = ok & F.when(there, F.coalesce(got.rlike(f"^({kinds[kind]})"), F.lit(False))).otherwise(F.lit(not required))
    return F.coalesce(ok, F.lit(False))


def levels(calls: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """calls: (conv, id, needs array<string>). (conv, id, level) of those that can be ordered.

    Chains of calls with one need each are followed by pointer doubling up to an anchor, a call that needs nothing or
    several: rounds grow with the logarithm of a chain. Anchors with several needs then get their levels one depth
    of them a round, until none is new. Each round is written before the next. An error is raised if max_rounds is
    set and calls are left after it.
    """
    c = common.cut(calls.select("conv", "id", F.array_distinct(F.coalesce("needs", F.array())).alias("needs")).dropDuplicates(["conv", "id"]), "calls")
    anchor = F.size("needs") != 1
    known = c.select("conv", F.col("id").alias("at"))
    walk = c.where(~anchor).select("conv", "id", F.col("needs")[0].alias("at"), F.lit(1).alias("far")).join(known, ["conv", "at"], "left_semi")
    walk = walk.unionByName(c.where(anchor).select("conv", "id", F.col("id").alias("at"), F.lit(0).alias("far")))
    walk = common.cut(walk.join(c.where(anchor).select("conv", F.col("id").alias("at"), F.lit(True).alias("done")), ["conv", "at"], "left").fillna(False, ["done"]), "walk")
    for _ in range(64):
        if walk.where("NOT done").limit(1).count() == 0:
            break
        on = walk.select("conv", F.col("id").alias("at"), F.col("at").alias("at2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = walk.where("NOT done").join(on, ["conv", "at"]).select("conv", F.col("at2").alias("at"), "id", (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        # a cycle's pointers never reach an anchor; no chain is as long as 2 ^ 30, so what has gone so far is one
        walk = common.cut(walk.where("done").select("conv", "at", "id", "far", "done").unionByName(moved.where(F.col("done") | (F.col("far") < 1 << 30))), "walk")
    level = common.cut(c.where(F.size("needs") == 0).select("conv", F.col("id").alias("at"), F.lit(0).alias("level")), "level")
    left = c.where(F.size("needs") > 1)
    for _ in count() if max_rounds is None else range(max_rounds):
        if left.limit(1).count() == 0:
            break
        need = left.select("conv", "id", F.size("needs").alias("n"), F.explode("needs").alias("need"))
        reach = walk.select("conv", F.col("id").alias("need"), "at", "far").join(level, ["conv", "at"]).select("conv", "need", (F.col("far") + F.col("level")).alias("level"))
        met = need.join(reach, ["conv", "need"]).groupBy("conv", "id").agg(F.count("*").alias("m"), F.max("level").alias("level"), F.max("n").alias("n")).where("m = n")
        fresh = common.cut(met.select("conv", F.col("id").alias("at"), (F.col("level") + 1).alias("level")), "fresh")
        if fresh.limit(1).count() == 0:
            break
        level = common.cut(level.unionByName(fresh), "level")
        left = common.cut(left.join(fresh.select("conv", F.col("at").alias("id")), ["conv", "id"], "left_anti"), "left")
    else:
        if left.limit(1).count():
            raise RuntimeError("calls are left after max_rounds")
    return walk.join(level, ["conv", "at"]).select("conv", "id", (F.col("far") + F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], others: DataFrame | None = None) -> DataFrame:
    """calls: (conv, turn, id, name, arguments, needs); results: (conv, turn, id, content); others, messages that neither call nor answer: (conv, turn, role, content).

    A row for each call, for each result that no call takes and for each other message: conv, turn, id, level, linked, valid, line.
    """
    first = Window.partitionBy("conv", "id").orderBy("turn", "content")
    r, has_key = results.select("conv", "turn", "id", "content"), F.col("conv").isNotNull() & F.col("id").isNotNull()
    keyed = r.where(has_key).withColumn("nth", F.row_number().over(first)).unionByName(r.where(~has_key).withColumn("nth", F.lit(None).cast("int")))
    taken = keyed.where("nth = 1").select("conv", "id", F.col("content").alias("_content"), F.lit(True).alias("_hit"))
    ok = F.lit(False)
    for name, schema in schemas.items():
        ok = F.when(F.col("name") == name, valid(F.col("arguments"), schema)).otherwise(ok)
    lined = canonical(arguments=canonical_json(F.col("arguments")), content=F.col("_content"), id=F.col("id"), name=F.col("name"), role=F.lit("assistant"))
    a = (
        calls.select("conv", "turn", "id", "name", "arguments", "needs").join(taken.hint("shuffle_hash"), ["conv", "id"], "left").join(levels(calls), ["conv", "id"], "left")
        .select("conv", "turn", "id", "level", F.coalesce("_hit", F.lit(False)).alias("linked"), ok.alias("valid"), lined.alias("line"))
    )
    known = calls.select("conv", "id").distinct().withColumn("_known", F.lit(True))
    orphan = keyed.join(known, ["conv", "id"], "left").where("_known IS NULL OR nth > 1")
    b = orphan.select("conv", "turn", "id", F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit(False).alias("valid"), canonical(content=F.col("content"), id=F.col("id"), role=F.lit("tool")).alias("line"))
    if others is None:
        return a.unionByName(b)
    c = others.select("conv", "turn", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit(False).alias("valid"), canonical(content=F.col("content"), role=F.col("role")).alias("line"))
    return a.unionByName(b).unionByName(c)


#: The tool that the query's calls name; every argument is required but the last.
REPLY = {"reply": {"turn": ("integer", True), "text": ("string", True), "after": ("string", False)}}


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations table as calls and results: a user's turn calls the tool `reply`, an assistant's turn is the result of the turn before it.

    A call needs the result of the user's turn two before it, if the conversation has one. Rows with a null
    conversation or turn have no identifier.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    ident = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    users = c.where("role = 'user'")
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("_before")).distinct()
    u = users.join(earlier, ["conv_id", "turn"], "left")
    calls = u.select(
        F.col("conv_id").alias("conv"), "turn", ident(F.col("turn")).alias("id"), F.lit("reply").alias("name"),
        canonical(turn=F.col("turn"), text=F.col("text"), after=F.when(F.col("_before"), ident(F.col("turn") - 2))).alias("arguments"),
        F.when(F.col("_before"), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = c.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), "turn", ident(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    return calls, results


def other_messages(conversations: DataFrame) -> DataFrame:
    """The rows of the conversations table that calls_and_results leaves to no role: system, any other and null roles."""
    c = conversations.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    return c.select(F.col("conv_id").alias("conv"), "turn", "role", F.col("text").alias("content"))
