"""Project detection, relevant messages and rule extraction: messages (history_id, number, role, date, text) in, long item tables out.

Everything is keyed by history and joins or groups on it, so partitions hold whole histories and nothing is global.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as t

IDENTIFIER = r"(?U)\b([A-Za-zА-Яа-яЁё][\w-]{1,40}_[\w.-]{2,60})\b"
NAMED = r"(?iU)(?:проект|project)\s*[«\"']?\s*[:—-]?\s*([A-Za-zА-Яа-яЁё][\w.-]{2,60})"


def mentions(messages: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(history_id, number, pattern, place, raw, name) of every project name found."""
    hits = [F.when(F.contains("text", F.lit("_")), F.regexp_extract_all("text", F.lit(IDENTIFIER), 1)).otherwise(F.array().cast("array<string>")), F.regexp_extract_all("text", F.lit(NAMED), 1)]
    bare = lambda h: F.regexp_replace(h, r"""^[. ,'"»]+|[. ,'"»]+$""", "")
    found = F.array(*[F.struct(F.lit(i).alias("pattern"), F.transform(h, bare).alias("hits")) for i, h in enumerate(hits)])
    rows = messages.select("history_id", "number", F.explode(found).alias("f")).select("history_id", "number", "f.pattern", F.posexplode("f.hits").alias("place", "raw"))
    # exploded and not filtered: a name that a filter asks for several times is made several times
    fine = lambda n: n.isNotNull() & ~n.isin(t.GENERIC_NAMES) & ~n.rlike("^(test_|memory_)")
    return rows.select("*", F.explode(F.filter(F.array(t.safe_name(F.col("raw"), ascii_only)), fine)).alias("name"))


def candidates(messages: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(history_id, project, display_name, message_numbers, occurrences, confidence, rank)."""
    g = mentions(messages, ascii_only).groupBy("history_id", F.col("name").alias("project")).agg(
        F.min_by("raw", F.struct("number", "pattern", "place")).alias("raw"), F.sort_array(F.collect_set("number")).alias("message_numbers"), F.count("*").alias("occurrences"))
    order = Window.partitionBy("history_id").orderBy(F.col("occurrences").desc(), "project")
    return g.select("history_id", "project", t.title(F.col("raw")).alias("display_name"), "message_numbers", "occurrences",
                    F.when(F.size("message_numbers") >= 2, "HIGH").otherwise("MEDIUM").alias("confidence"), F.row_number().over(order).alias("rank"))


def relevant(messages: DataFrame, projects: DataFrame) -> DataFrame:
    """Messages of each project: those that name it or an alias, explicit numbers, and the message after each; all of the history if none.

    projects: (history_id, project, display_name, aliases, message_numbers). An equi-join by history, then the substring test.
    """
    folded = lambda c: F.replace(t.fold(c), F.lit("_"), F.lit(" "))
    names = F.transform(F.filter(F.concat(F.array("project", "display_name"), F.coalesce("aliases", F.array())), lambda a: a != ""), folded)
    p = projects.select("history_id", "project", "display_name", names.alias("names"), "message_numbers")
    m = messages.withColumn("searchable", folded(F.col("text")))
    hit = F.array_contains("message_numbers", F.col("number")) | F.exists("names", lambda n: F.contains(F.col("searchable"), n))
    w = Window.partitionBy("history_id", "project")
    both = m.join(p, "history_id").withColumn("hit", hit)
    both = both.withColumn("after", F.coalesce(F.lag("hit").over(w.orderBy("number")) & (F.lag("number").over(w.orderBy("number")) == F.col("number") - 1), F.lit(False)))
    both = both.withColumn("any", F.max("hit").over(w))
    return both.where(F.col("hit") | F.col("after") | ~F.col("any")).select("history_id", "project", "display_name", "number", "role", "date", "text")


def technologies(rel: DataFrame) -> DataFrame:
    """(history_id, project, label, number): each technology with the first relevant message that names it."""
    low = t.fold(F.col("text"))
    hits = F.filter(F.array(*[F.when(low.rlike(rf"(?U)(?<!\w){n}(?!\w)"), F.lit(label)) for n, label in t.TECHNOLOGIES.items()]), lambda x: x.isNotNull())
    return rel.select("history_id", "project", "number", F.explode(F.array_distinct(hits)).alias("label")).groupBy("history_id", "project", "label").agg(F.min("number").alias("number"))


def lines(rel: DataFrame) -> DataFrame:
    """Useful lines with all their classes."""
    both = F.transform(t.useful_lines(F.col("text")), lambda x: F.struct(x.alias("line"), t.fold(x).alias("low")))  # folded here, once, and not by each class
    x = rel.select("history_id", "project", "display_name", "number", "date", F.posexplode(both).alias("line_no", "l")).select("history_id", "project", "display_name", "number", "date", "line_no", "l.line", "l.low")
    status = F.when(t.has_word(F.col("low"), t.COMPLETED), "completed").when(t.has_word(F.col("low"), t.BUG), "bug").when(t.has_word(F.col("low"), t.TODO), "todo").when(t.has_word(F.col("low"), t.IDEA), "idea")
    return (
        x.withColumn("status", status).withColumn("is_decision", t.has_word(F.col("low"), t.DECISION)).withColumn("is_constraint", t.has_word(F.col("low"), t.CONSTRAINT))
        .withColumn("is_question", F.contains("line", F.lit("?")) & t.has_word(F.col("low"), t.QUESTION))
    )


def items(classified: DataFrame, techs: DataFrame) -> DataFrame:
    """The extraction as a long table: (history_id, project, field, number, line_no, text, status, confidence, date)."""
    def item(on: Column, field: str, text: Column, status: Column, confidence: str, date: Column) -> Column:
        return F.when(on, F.struct(F.lit(field).alias("field"), text.alias("text"), status.alias("status"), F.lit(confidence).alias("confidence"), date.alias("date")))

    none, line, date = F.lit(None).cast("string"), F.col("line"), F.coalesce("date", F.lit(""))
    made = F.array(
        item(F.col("status") == "completed", "implemented", line, none, "MEDIUM", none), item(F.col("status").isNotNull(), "tasks", line, F.col("status"), "MEDIUM", none),
        item(F.col("is_decision"), "decisions", line, none, "HIGH", date), item(F.col("is_constraint"), "constraints", line, none, "HIGH", none),
        item(F.col("is_constraint"), "do_not_change", line, none, "HIGH", none), item(F.col("is_question"), "open_questions", F.concat(F.lit(t.NEEDS_REVIEW + " "), line), none, "LOW", none))
    a = classified.select("history_id", "project", "number", "line_no", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select("history_id", "project", "i.field", "number", "line_no", "i.text", "i.status", "i.confidence", "i.date")
    b = techs.select("history_id", "project", F.lit("technologies").alias("field"), "number", F.lit(-1).alias("line_no"), F.col("label").alias("text"), none.alias("status"), F.lit("MEDIUM").alias("confidence"), none.alias("date"))
    return a.unionByName(b)


def summaries(classified: DataFrame, projects: DataFrame) -> DataFrame:
    """(history_id, project, summary): the first useful line that holds the name, cut at 500, or the sentence for none."""
    named = classified.where(F.contains("low", t.fold(F.col("project"))) | F.contains("low", t.fold(F.col("display_name"))))
    first = named.groupBy("history_id", "project").agg(F.min_by("line", F.struct("number", "line_no")).alias("line"))
    none = F.concat(F.lit(t.NEEDS_REVIEW + " Назначение проекта "), F.col("display_name"), F.lit(" не удалось надёжно определить."))
    return projects.select("history_id", "project", "display_name").join(first, ["history_id", "project"], "left").select("history_id", "project", F.coalesce(F.substring("line", 1, 500), none).alias("summary"))


def secret_scan(texts: DataFrame) -> DataFrame:
    """texts: (id, text). (id, finding): private keys, API keys and personal Windows paths."""
    rules = {
        "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
        "API key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
        "personal path": r"[A-Za-z]:\\Users\\(?!Example\\)[^\\\s]+\\",
    }
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in rules.items()]), lambda x: x.isNotNull())
    return texts.select("id", F.explode(found).alias("finding"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
