"""Meeting new items with stored ones: facts by key, scalars, explicit technology changes, and the order of the whole run.

Items are rows of (project, field, pos, is_old, id, text, status, confidence, blocks, evidence, reason, date, previous);
stored ones have is_old and their place in the list as pos. Everything is keyed by project, so documents of any number
are brought up to date in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as t
from lorekeep.sources.runtime import cut

from . import fold
from .document import AGENT_FIELDS, FACT_FIELDS, TASK_FIELDS

CHANGE = r"(?iU)(?:с|from)\s+([\w.+#-]+)\s+(?:на|to)\s+([\w.+#-]+)"
ITEM = ["project", "field", "pos", "is_old", "id", "text", "status", "confidence", "blocks", "evidence", "reason", "date", "previous"]
EVIDENCE = "array<struct<source:string,source_blocks:array<int>,observed_at:string>>"
HISTORY = "array<struct<date:string,source:string,mode:string>>"


def kind(field: Column) -> Column:
    """What an item's id is made of beside its text."""
    return F.when(field.isin(*AGENT_FIELDS), F.concat(F.lit("agent_instructions."), field)).when(field.isin("tasks", *TASK_FIELDS), "tasks").otherwise(field)


def canonical(new: DataFrame, source: Column, observed_at: Column) -> DataFrame:
    """new: (project, field, pos, text, status, confidence, blocks and, if there are, reason, date, previous). Items with id, default status, clean confidence, sorted blocks and one entry of evidence; blank texts go."""
    more = {c: F.coalesce(t.strip(F.col(c)), F.lit("")) if c in new.columns else F.lit("") for c in ("reason", "date", "previous")}
    field, status = F.col("field"), F.col("status")
    fine = F.when(field == "tasks", F.when(F.lower(status).isin(*TASK_FIELDS.values()), F.lower(status)).otherwise("todo")).when(status.isin("active", "superseded") | (status == "disputed") & (field != "decisions"), status).otherwise("active")
    blocks = F.array_sort(F.array_distinct(F.filter(F.coalesce("blocks", F.array().cast("array<int>")), lambda b: b > 0)))
    x = new.withColumn("text", t.strip(F.col("text"))).where("text <> ''").withColumn("blocks", blocks)
    evidence = F.array(F.struct(source.alias("source"), F.col("blocks").alias("source_blocks"), observed_at.alias("observed_at")))
    return x.select("project", "field", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("is_old"), t.stable_id(kind(field), F.col("text")).alias("id"), "text", fine.alias("status"),
                    t.clean_confidence(F.col("confidence")).alias("confidence"), F.col("blocks").cast("array<int>").alias("blocks"), evidence.cast(EVIDENCE).alias("evidence"), *[c.alias(k) for k, c in more.items()])


def merge_items(items: DataFrame) -> DataFrame:
    """Facts of every list. A new item meets the stored item of its key, the last if there are several, or else the first new one.

    What is met keeps id and text and gets united blocks, new evidence in order, the highest confidence and the last status
    that isn't active. Stored items of the same key before the last stay as they are. Empty keys meet each other. pos is
    that of the row that was first.
    """
    x = items.withColumn("key", t.match_key(F.col("text"))).withColumn("_new", (~F.col("is_old")).cast("int"))
    # of several stored items of one key, all but the last are groups of their own
    after = F.sum(1 - F.col("_new")).over(Window.partitionBy("project", "field", "key").orderBy("_new", F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("slot", F.when(F.col("_new") == 1, 1).otherwise(after))
    order, first = F.struct("_new", "pos"), F.struct("is_old", "pos", "id", "text", "status", "confidence", "blocks", "evidence", "reason", "date", "previous")
    changed = F.col("status").isin("superseded", "disputed")
    g = x.groupBy("project", "field", "key", "slot").agg(
        F.min_by(first, order).alias("b"), F.count("*").alias("n"), F.max_by(F.when(changed, F.col("status")), F.when(changed, order)).alias("changed"),
        F.max_by("confidence", F.struct(t.confidence_rank(F.col("confidence")), -F.col("_new"), -F.col("pos"))).alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("all_blocks"),
        F.array_sort(F.collect_list(F.struct("_new", "pos", "evidence"))).alias("all_evidence"))
    added = F.array_except(F.flatten(F.transform("all_evidence", lambda e: e["evidence"])), F.col("b.evidence"))
    return g.select("project", "field", "b.pos", "b.is_old", "b.id", "b.text", F.coalesce("changed", "b.status").alias("status"), F.when(F.col("n") > 1, F.col("best")).otherwise(F.col("b.confidence")).alias("confidence"),
                    F.when(F.col("n") > 1, F.col("all_blocks")).otherwise(F.col("b.blocks")).alias("blocks"), F.concat("b.evidence", added).alias("evidence"), "b.reason", "b.date", "b.previous")


def choose_scalar(old: Column, new: Column) -> Column:
    """The new value if it isn't empty and reliable or the old one is empty; else the old one."""
    new, old = t.strip(F.coalesce(new, F.lit(""))), F.coalesce(old, F.lit(""))
    return F.when((new != "") & (~new.startswith(t.NEEDS_REVIEW) | (t.strip(old) == "")), new).otherwise(old)


def technology_changes(decisions: DataFrame) -> DataFrame:
    """decisions with old_name and new_name: those that replace one technology by another. A stated previous wins over the sentence's old name."""
    old = F.when(F.coalesce("previous", F.lit("")) != "", F.col("previous")).otherwise(F.regexp_extract("text", CHANGE, 1))
    return decisions.withColumn("old_name", old).withColumn("new_name", F.regexp_extract("text", CHANGE, 2)).where("old_name <> '' AND new_name <> ''")


def apply_changes(technologies: DataFrame, changes: DataFrame) -> DataFrame:
    """technologies: merged items, pos their place; changes: technology_changes() of canonical decisions.

    Changes come in the order of pos. Each supersedes all items of the old name that there are by then, those made by
    earlier changes too, and then observes the new name with high confidence. So an item is superseded if some change
    after the one that made it (any, if none did) names it; that is a maximum by key, not a loop.
    """
    new = changes.withColumn("text", F.col("new_name")).withColumn("field", F.lit("technologies")).withColumn("id", t.stable_id(F.col("field"), F.col("text")))
    new = new.withColumn("status", F.lit("active")).withColumn("confidence", F.lit("HIGH")).withColumn("is_old", F.lit(False)).select(*ITEM)
    merged = merge_items(technologies.withColumn("is_old", F.lit(True)).select(*ITEM).unionByName(new)).withColumn("_key", t.match_key(F.col("text")))
    last = changes.groupBy("project", t.match_key(F.col("old_name")).alias("_key")).agg(F.max("pos").alias("_gone"))
    gone = F.col("_gone").isNotNull() & (F.col("is_old") | (F.col("_gone") > F.col("pos")))
    return merged.join(last, ["project", "_key"], "left").withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).select(*ITEM)


def placed(items: DataFrame) -> DataFrame:
    """pos becomes the place in the list, from 0: stored items first."""
    w = Window.partitionBy("project", "field").orderBy(F.col("is_old").desc(), "pos")
    return items.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def empty_documents(candidates: DataFrame) -> DataFrame:
    """candidates: (project, display_name, aliases). Documents without anything in them yet."""
    name = F.when(F.coalesce("display_name", F.lit("")) != "", F.col("display_name")).otherwise(t.title(F.col("project")))
    text = {c: F.lit("") for c in ("summary", "purpose", "created_at", "last_updated")}
    return candidates.select("project", name.alias("display_name"), F.array().cast("array<string>").alias("aliases"), *[c.alias(k) for k, c in text.items()], F.array().cast(HISTORY).alias("update_history"))


def reconcile(docs: DataFrame | None, items: DataFrame | None, candidates: DataFrame, scalars: DataFrame, extraction: DataFrame, source: str, observed_at: str) -> tuple[DataFrame, DataFrame]:
    """The documents and items of all candidates after one run. docs, items: what is stored, None for nothing.

    candidates: (project, display_name, aliases); scalars: (project, summary, purpose); extraction: as canonical() takes it.
    Order: scalars, facts, decisions, tasks, instructions, technology changes (which see the facts merged already), then
    times and the event. A document that was there is an update, any other is created.
    """
    src, now = F.lit(source or "unknown"), F.lit(observed_at)
    own = candidates.select("project")
    base = empty_documents(candidates).withColumn("_old", F.lit(False))
    if docs is not None:
        stored = docs.join(own, "project", "left_semi").select(*[c for c in base.columns if c != "_old"]).withColumn("_old", F.lit(True))
        base = base.join(stored.select("project"), "project", "left_anti").unionByName(stored)
    new = scalars.select("project", F.col("summary").alias("_summary"), F.col("purpose").alias("_purpose"))
    named = candidates.select("project", F.col("display_name").alias("_name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("_aliases"))
    d = base.join(named, "project").join(new, "project", "left")
    event = F.array(F.struct(now.alias("date"), F.lit(source).alias("source"), F.when(F.col("_old"), "update").otherwise("create").alias("mode")))
    out = d.select("project", F.when(F.coalesce("_name", F.lit("")) != "", F.col("_name")).otherwise(F.col("display_name")).alias("display_name"), F.array_sort(F.array_union("aliases", "_aliases")).alias("aliases"),
                   choose_scalar(F.col("summary"), F.col("_summary")).alias("summary"), choose_scalar(F.col("purpose"), F.col("_purpose")).alias("purpose"),
                   F.when(F.coalesce("created_at", F.lit("")) != "", F.col("created_at")).otherwise(now).alias("created_at"), now.alias("last_updated"), F.concat("update_history", event.cast(HISTORY)).alias("update_history"))

    every = canonical(extraction.join(own, "project", "left_semi"), src, now)
    if items is not None:
        every = every.unionByName(items.join(own, "project", "left_semi").withColumn("is_old", F.lit(True)).select(*ITEM))
    every = cut(every, "observed")  # read once for each kind of list
    lists = lambda *f: every.where(F.col("field").isin(*f))
    facts = placed(merge_items(lists(*FACT_FIELDS, *AGENT_FIELDS)))
    changes = technology_changes(lists("decisions").where("NOT is_old"))
    tech = placed(apply_changes(facts.where("field = 'technologies'"), changes))
    folded = fold.fold(lists("decisions"), "decisions").unionByName(fold.fold(lists("tasks", *TASK_FIELDS), "tasks"))
    merged = facts.where("field <> 'technologies'").unionByName(tech).unionByName(folded.withColumn("is_old", F.lit(True)).select(*ITEM))
    return out, merged.drop("is_old")
