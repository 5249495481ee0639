"""The stored document: sanitising, migration of older versions, validation as a table of violations, rendering."""

from __future__ import annotations

import json as json_module

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as t
from lorekeep.sources.runtime import ship

VERSION = 3
FACT_FIELDS = ["technologies", "architecture", "components", "implemented", "constraints", "open_questions"]
TASK_FIELDS = {"current_tasks": "current", "todo_tasks": "todo", "completed_tasks": "completed", "ideas": "idea", "known_bugs": "bug"}
AGENT_FIELDS = ["structure", "commands", "conventions", "rules", "do_not_change"]
#: Headings of rendered files, fixed values.
HEADINGS = {"technologies": "Технологии", "architecture": "Архитектура", "components": "Важные компоненты", "implemented": "Реализовано", "constraints": "Ограничения и проблемы", "open_questions": "Открытые вопросы"}
TASK_HEADINGS = {"current_tasks": "Сейчас в работе", "todo_tasks": "Осталось сделать", "known_bugs": "Известные баги", "ideas": "Идеи на потом", "completed_tasks": "Выполнено"}
AGENT_HEADINGS = {"structure": "Структура проекта", "commands": "Команды", "conventions": "Соглашения", "rules": "Архитектурные правила", "do_not_change": "Не менять без необходимости"}
NO_DATA, UNDEFINED = "Пока нет данных.", "[NEEDS_REVIEW] Информация пока не определена."


KEYS = ["schema_version", "project", "display_name", "aliases", "summary", "purpose", *FACT_FIELDS[:5], *TASK_FIELDS, "decisions", "open_questions", "agent_instructions", "update_history", "created_at", "last_updated"]
STRINGS = ["project", "display_name", "summary", "purpose", "created_at", "last_updated"]
#: An item's keys by what it is, beside its text.
ITEM_KEYS = ["id", "status", "confidence", "source_blocks", "evidence"]
EVIDENCE = "array<struct<source:string,source_blocks:array<int>,observed_at:string>>"


# ---- JSON of unknown shape, as VARIANT expressions
def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({kinds})"), F.lit(False))


def _text(v: Column, path: str = "$") -> Column:
    """A scalar as text; '' for null and what isn't there."""
    return _scalar(_get(v, path))


def _scalar(x: Column) -> Column:
    return F.coalesce(F.when(_is(x, "STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN"), _get(x, "$", "string")), F.lit(""))


def _either(v: Column, first: str, second: str) -> Column:
    """The first of two keys with something in it, stripped."""
    a = _text(v, f"$.{first}")
    return t.strip(F.when(a != "", a).otherwise(_text(v, f"$.{second}")))


def _blocks(v: Column) -> Column:
    """Positive whole numbers, numbers in text too, in first-seen order."""
    of = lambda x: F.when(_is(x, "STRING|BIGINT|DOUBLE|DECIMAL"), F.regexp_extract(t.strip(_get(x, "$", "string")), r"^\+?(\d{1,9})(\.\d*)?$", 1))
    numbers = F.transform(F.coalesce(_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_element_at(F.array(F.nullif(of(x), F.lit(""))), F.lit(1)).cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def unfenced(content: Column) -> Column:
    """JSON text out of a Markdown code fence, if it stands in one."""
    x = t.strip(content)
    inner = F.regexp_extract(x, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(x.rlike(r"(?is)^```(?:json)?\s*(.*?)\s*```$"), inner).otherwise(x)


def answer_errors(answers: DataFrame) -> DataFrame:
    """answers: (id, content). (id, error) of those that no extraction can be made of."""
    x = answers.withColumn("v", F.try_parse_json(unfenced(F.col("content"))))
    v = F.col("v")
    wrong = [F.when(_get(v, f"$.{f}").isNotNull() & ~_is(_get(v, f"$.{f}"), "ARRAY"), F.lit(f"{f}: no list")) for f in [*FACT_FIELDS, "decisions", "tasks"]]
    wrong.append(F.when(_get(v, "$.agent_instructions").isNotNull() & ~_is(_get(v, "$.agent_instructions"), "OBJECT"), F.lit("agent_instructions: no object")))
    error = F.when(v.isNull(), F.array(F.lit("no JSON"))).when(~_is(v, "OBJECT"), F.array(F.lit("no object"))).otherwise(F.filter(F.array(*wrong), lambda e: e.isNotNull()))
    return x.select("id", F.explode(error).alias("error"))


def sanitise(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: (id, content), without errors. Scalars (id, summary, purpose) and items (id, field, pos, text, status, confidence, blocks, reason, date, previous).

    Unknown keys, blank texts and items of other kinds go, unknown values get defaults, blocks keep positive whole numbers
    in first-seen order. Facts may be plain strings (no confidence, no blocks), decisions too; tasks must be objects with
    a title. Decisions lose any status.
    """
    v = F.try_parse_json(unfenced(F.col("content")))
    x = answers.select("id", v.alias("v"))
    scalars = x.select("id", t.strip(_text(F.col("v"), "$.summary")).alias("summary"), t.strip(_text(F.col("v"), "$.purpose")).alias("purpose"))
    lists = F.array(*[F.struct(F.lit(f).alias("field"), _get(F.col("v"), path, "array<variant>").alias("list")) for f, path in
                      [*[(f, f"$.{f}") for f in [*FACT_FIELDS, "decisions", "tasks"]], *[(f, f"$.agent_instructions.{f}") for f in AGENT_FIELDS]]])
    e = x.select("id", F.explode(lists).alias("l")).select("id", "l.field", F.posexplode("l.list").alias("pos", "e"))
    field, item = F.col("field"), F.col("e")
    is_text, is_object = _is(item, "STRING"), _is(item, "OBJECT")
    text = F.when(field == "tasks", F.when(is_object, t.strip(_text(item, "$.title")))).when(is_text, t.strip(_text(item))).when(is_object & (field == "decisions"), _either(item, "title", "text")).when(is_object, _either(item, "text", "title"))
    raw = F.lower(_text(item, "$.status"))
    status = F.when(field == "tasks", F.when(raw.isin(*TASK_FIELDS.values()), raw).otherwise("todo")).when((field != "decisions") & raw.isin("active", "superseded", "disputed"), raw)
    plain = is_text & (field != "decisions")
    more = [F.when(field == "decisions", t.strip(_text(item, f"$.{c}"))).alias(c) for c in ("reason", "date", "previous")]
    out = e.select("id", "field", F.col("pos").cast("long").alias("pos"), text.alias("text"), status.alias("status"), F.when(~plain, t.clean_confidence(_text(item, "$.confidence"))).alias("confidence"),
                   F.when(plain, F.array().cast("array<int>")).otherwise(_blocks(_get(item, "$.source_blocks"))).alias("blocks"), *more)
    return scalars, out.where("text <> ''")


# ---- stored documents
def _paths() -> list[tuple[str, str]]:
    return [*[(f, f"$.{f}") for f in [*FACT_FIELDS, *TASK_FIELDS, "decisions"]], *[(f, f"$.agent_instructions.{f}") for f in AGENT_FIELDS]]


def read_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: (project, content), without errors. Documents and items of version 3; older versions are brought up to it.

    Version 1 gets what is missing by default, and created_at from the first dated event, else from last_updated. Before
    version 3 items may be strings or objects: they get an id, a default status by list and no evidence.
    """
    x = files.select("project", F.try_parse_json("content").alias("v")).withColumn("version", _get(F.col("v"), "$.schema_version", "int"))
    v, old, first_version = F.col("v"), F.col("version") < 3, F.col("version") == 1
    events = F.coalesce(_get(v, "$.update_history", "array<variant>"), F.array().cast("array<variant>"))
    history = F.transform(events, lambda e: F.struct(_text(e, "$.date").alias("date"), _text(e, "$.source").alias("source"), _text(e, "$.mode").alias("mode")))
    dates = F.filter(F.transform(events, lambda e: F.when(_is(_get(e, "$.date"), "STRING"), _text(e, "$.date")).otherwise("")), lambda d: d != "")
    created = F.when(first_version, F.coalesce(F.try_element_at(dates, F.lit(1)), F.when(_is(_get(v, "$.last_updated"), "STRING"), _text(v, "$.last_updated")), F.lit(""))).otherwise(_text(v, "$.created_at"))
    name = F.when(_text(v, "$.display_name") != "", _text(v, "$.display_name")).otherwise(t.title(t.strip(_text(v, "$.project"))))
    docs = x.select("project", F.when(first_version, name).otherwise(_text(v, "$.display_name")).alias("display_name"), F.coalesce(_get(v, "$.aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"),
                    _text(v, "$.summary").alias("summary"), _text(v, "$.purpose").alias("purpose"), created.alias("created_at"), _text(v, "$.last_updated").alias("last_updated"), history.alias("update_history"))
    lists = F.array(*[F.struct(F.lit(f).alias("field"), _get(v, path, "array<variant>").alias("list")) for f, path in _paths()])
    e = x.select("project", old.alias("old"), F.explode(F.filter(lists, lambda l: l["list"].isNotNull())).alias("l")).select("project", "old", "l.field", F.posexplode("l.list").alias("pos", "e"))
    # in steps, each of which uses the last one's columns several times: so nothing is evaluated twice, and no method grows too long to be compiled
    parts = ["title", "text", "status", "confidence", "id"]
    e = e.select("*", _is(F.col("e"), "OBJECT").alias("_object"), *[_get(F.col("e"), f"$.{c}").alias(f"_{c}") for c in parts])
    e = e.select("project", "old", "field", "pos", "e", "_object", F.col("field").isin("decisions", *TASK_FIELDS).alias("_titled"), F.when(~F.col("_object"), _scalar(F.col("e"))).alias("_plain"), *[_scalar(F.col(f"_{c}")).alias(f"_{c}") for c in parts])
    field, item, was, titled = F.col("field"), F.col("e"), F.col("old"), F.col("_titled")
    first, second = F.when(titled, F.col("_title")).otherwise(F.col("_text")), F.when(titled, F.col("_text")).otherwise(F.col("_title"))
    e = e.withColumn("_first", first).withColumn("_made", t.strip(F.when(~F.col("_object"), F.col("_plain")).when(F.col("_first") != "", F.col("_first")).otherwise(second)))
    text = F.col("_made")
    kind = F.when(field.isin(*AGENT_FIELDS), F.concat(F.lit("agent_instructions."), field)).when(field.isin(*TASK_FIELDS), "tasks").otherwise(field)
    by_list = F.create_map(*[x for k, s in TASK_FIELDS.items() for x in (F.lit(k), F.lit(s))])
    raw = F.col("_status")
    allowed = F.when(field.isin(*TASK_FIELDS), raw.isin(*TASK_FIELDS.values())).when(field == "decisions", raw.isin("active", "superseded")).otherwise(raw.isin("active", "superseded", "disputed"))
    evidence = F.from_json(F.to_json(_get(item, "$.evidence")), EVIDENCE)
    blocks = F.coalesce(_get(_get(item, "$.source_blocks"), "$", "array<int>"), F.array().cast("array<int>"))
    given = [F.when(field == "decisions", _text(item, f"$.{c}")).otherwise("").alias(c) for c in ("reason", "date", "previous")]
    items = e.select("project", "field", F.col("pos").cast("long").alias("pos"), F.when(was, t.stable_id(kind, text)).otherwise(F.col("_id")).alias("id"), F.when(was, text).otherwise(F.col("_first")).alias("text"),
                     F.when(~was | allowed, raw).otherwise(F.coalesce(by_list[field], F.lit("active"))).alias("status"), F.when(was, t.clean_confidence(F.when(F.col("_confidence") != "", F.col("_confidence")))).otherwise(F.col("_confidence")).alias("confidence"),
                     blocks.alias("blocks"), F.when(was, F.array().cast(EVIDENCE)).otherwise(evidence).alias("evidence"), *given)
    return docs, items


def migrate_dates(docs: DataFrame) -> DataFrame:
    """(project, schema_version, created_at, last_updated, history_dates): created_at of version 1 is the first non-empty date of its history, else last_updated."""
    first = F.try_element_at(F.filter(F.coalesce("history_dates", F.array()), lambda d: d != ""), F.lit(1))
    made = F.when(F.col("schema_version") < 2, F.coalesce(first, "last_updated", F.lit(""))).otherwise(F.coalesce("created_at", F.lit("")))
    return docs.select("project", F.lit(VERSION).alias("schema_version"), made.alias("created_at"), F.coalesce("last_updated", F.lit("")).alias("last_updated"))


def _whole_blocks(v: Column) -> Column:
    """A list of different positive whole numbers."""
    own = _get(v, "$", "array<variant>")
    n = _get(v, "$", "array<bigint>")
    return _is(v, "ARRAY") & F.forall(own, lambda b: _is(b, "BIGINT")) & F.forall(n, lambda b: b > 0) & (F.size(n) == F.size(F.array_distinct(n)))


def document_errors(files: DataFrame) -> DataFrame:
    """files: (project, content): stored documents as they are. (project, place, rule) for each broken rule; place is a list and item, or empty.

    Versions 1 and 2 are held to what their migration can't mend, version 3 to exact keys, types, values and ids.
    """
    x = files.withColumn("v", F.try_parse_json("content")).withColumn("kind", _get(F.col("v"), "$.schema_version")).withColumn("version", F.when(_is(F.col("kind"), "BIGINT"), _get(F.col("kind"), "$", "bigint")))
    v = F.col("v")
    there = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    needed = F.when(F.col("version") == 1, F.array(F.lit("schema_version"))).when(F.col("version") == 2, F.array(*[F.lit(k) for k in KEYS if k in (*STRINGS, "aliases", "update_history")])).otherwise(F.array(*map(F.lit, KEYS)))
    ok_version = F.coalesce(F.col("version").between(1, VERSION), F.lit(False))
    string = lambda k: F.when(F.array_contains(there, k) & ~_is(_get(v, f"$.{k}"), "STRING"), F.lit(f"{k}: no text"))
    events = _get(v, "$.update_history", "array<variant>")
    good_event = lambda e: (F.array_sort(F.coalesce(F.json_object_keys(F.to_json(e)), F.array().cast("array<string>"))) == F.array(*map(F.lit, ("date", "mode", "source")))) & _is(_get(e, "$.date"), "STRING") & _is(_get(e, "$.source"), "STRING") & _text(e, "$.mode").isin("create", "update")
    instructions = F.coalesce(F.json_object_keys(F.get_json_object("content", "$.agent_instructions")), F.array().cast("array<string>"))
    three = F.col("version") == 3
    rules = [
        *[string(k) for k in STRINGS], F.when(_text(v, "$.project") == "", F.lit("project: empty")),
        F.when(F.array_contains(there, "aliases") & ~F.coalesce(F.forall(_get(v, "$.aliases", "array<variant>"), lambda a: _is(a, "STRING")), F.lit(False)), F.lit("aliases: no list of texts")),
        F.when(F.array_contains(there, "update_history") & ~F.coalesce(_is(_get(v, "$.update_history"), "ARRAY") & F.forall(events, good_event), F.lit(False)), F.lit("update_history: wrong event")),
        F.when(three & (F.array_sort(instructions) != F.array(*map(F.lit, sorted(AGENT_FIELDS)))), F.lit("agent_instructions: wrong keys")),
        *[F.when(three & F.array_contains(there, f) & ~_is(_get(v, f"$.{f}"), "ARRAY"), F.lit(f"{f}: no list")) for f in [*FACT_FIELDS, *TASK_FIELDS, "decisions"]],
        *[F.when(three & ~_is(_get(v, f"$.agent_instructions.{f}"), "ARRAY"), F.lit(f"{f}: no list")) for f in AGENT_FIELDS],
    ]
    keys = F.concat(F.transform(F.array_except(needed, there), lambda k: F.concat(F.lit("missing "), k)), F.transform(F.array_except(there, F.array(*map(F.lit, KEYS))), lambda k: F.concat(F.lit("unknown "), k)))
    broken = F.when(v.isNull(), F.array(F.lit("no JSON"))).when(~_is(v, "OBJECT"), F.array(F.lit("no object"))).when(~ok_version, F.array(F.lit("schema_version"))).otherwise(F.concat(keys, F.filter(F.array(*rules), lambda r: r.isNotNull())))
    whole = x.select("project", F.lit("").alias("place"), F.explode(broken).alias("rule"))

    lists = F.array(*[F.struct(F.lit(f).alias("field"), _get(v, path, "array<variant>").alias("list")) for f, path in _paths()])
    e = x.where(ok_version).select("project", (F.col("version") == 3).alias("three"), F.explode(lists).alias("l")).select("project", "three", "l.field", F.posexplode("l.list").alias("pos", "e"))
    e = e.withColumn("keys", F.array_sort(F.coalesce(F.json_object_keys(F.to_json("e")), F.array().cast("array<string>")))).withColumn("item_id", F.when(_is(_get(F.col("e"), "$.id"), "STRING"), _text(F.col("e"), "$.id")))
    field, item = F.col("field"), F.col("e")
    titled = field.isin("decisions", *TASK_FIELDS)
    text = F.when(titled, _get(item, "$.title")).otherwise(_get(item, "$.text"))
    exact = F.when(field == "decisions", F.array(*map(F.lit, sorted([*ITEM_KEYS, "title", "reason", "date", "previous"])))).when(titled, F.array(*map(F.lit, sorted([*ITEM_KEYS, "title"])))).otherwise(F.array(*map(F.lit, sorted([*ITEM_KEYS, "text"]))))
    raw = _text(item, "$.status")
    allowed = F.when(field.isin(*TASK_FIELDS), raw.isin(*TASK_FIELDS.values())).when(field == "decisions", raw.isin("active", "superseded")).otherwise(raw.isin("active", "superseded", "disputed"))
    entry = lambda y: (F.array_sort(F.coalesce(F.json_object_keys(F.to_json(y)), F.array().cast("array<string>"))) == F.array(*map(F.lit, ("observed_at", "source", "source_blocks")))) & _is(_get(y, "$.source"), "STRING") & (_text(y, "$.source") != "") & _is(_get(y, "$.observed_at"), "STRING") & (_text(y, "$.observed_at") != "") & F.coalesce(_whole_blocks(_get(y, "$.source_blocks")), F.lit(False))
    evidence = _get(item, "$.evidence", "array<variant>")
    each = {
        "text": ~(_is(text, "STRING") & (t.strip(_text(text)) != "")), "keys": F.col("keys") != exact, "id": ~F.coalesce(F.col("item_id").rlike("^[0-9a-f]{20}$"), F.lit(False)),
        "confidence": ~_text(item, "$.confidence").isin("LOW", "MEDIUM", "HIGH"), "blocks": ~F.coalesce(_whole_blocks(_get(item, "$.source_blocks")), F.lit(False)),
        "evidence": ~F.coalesce(_is(_get(item, "$.evidence"), "ARRAY") & F.forall(evidence, entry), F.lit(False)), "status": ~allowed,
        "texts": (field == "decisions") & ~(_is(_get(item, "$.reason"), "STRING") & _is(_get(item, "$.date"), "STRING") & _is(_get(item, "$.previous"), "STRING")),
        "unique_id": F.count("*").over(Window.partitionBy("project", "field", "item_id")) > 1,
    }
    each = {k: F.col("three") & F.coalesce(c, F.lit(True)) for k, c in each.items()}
    # before version 3 only what the migration copies can be wrong
    was = {"text": (F.when(_is(item, "OBJECT"), F.when(titled, _either(item, "title", "text")).otherwise(_either(item, "text", "title"))).otherwise(t.strip(_text(item))) == ""),
           "blocks": _is(item, "OBJECT") & _get(item, "$.source_blocks").isNotNull() & _is(_get(item, "$.source_blocks"), "ARRAY") & ~F.coalesce(_whole_blocks(_get(item, "$.source_blocks")), F.lit(False))}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in each.items()], *[F.when(~F.col("three") & c, F.lit(k)) for k, c in was.items()]), lambda r: r.isNotNull())
    in_items = e.select("project", F.concat_ws(".", "field", F.col("pos").cast("string")).alias("place"), found.alias("found")).select("project", "place", F.explode("found").alias("rule"))
    twice = read_documents(files.join(x.where(F.col("version").between(1, 2)).select("project"), "project", "left_semi"))[1].groupBy("project", "field", "id").agg(F.count("*").alias("n")).where("n > 1")
    return whole.unionByName(in_items).unionByName(twice.select("project", F.col("field").alias("place"), F.lit("unique_id").alias("rule")))


def write_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(project, content): the JSON of each document, its keys in their order, two blanks of indent, a line feed at the end."""
    fact = F.struct("id", "text", "status", "confidence", F.col("blocks").alias("source_blocks"), "evidence")
    task = F.struct("id", F.col("text").alias("title"), "status", "confidence", F.col("blocks").alias("source_blocks"), "evidence")
    decision = F.struct("id", F.col("text").alias("title"), "reason", "date", "previous", "status", "confidence", F.col("blocks").alias("source_blocks"), "evidence")
    json = F.when(F.col("field") == "decisions", F.to_json(decision)).when(F.col("field").isin(*TASK_FIELDS), F.to_json(task)).otherwise(F.to_json(fact))
    g = items.groupBy("project", "field").agg(F.array_sort(F.collect_list(F.struct("pos", json.alias("j")))).alias("l"))
    g = g.select("project", "field", F.concat(F.lit("["), F.array_join(F.transform("l", lambda y: y["j"]), ","), F.lit("]")).alias("list"))
    g = g.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("field", "list"))).alias("lists"))
    x = docs.join(g, "project", "left")
    a_list = lambda f: F.coalesce(F.element_at("lists", f), F.lit("[]"))
    value = {f: a_list(f) for f in [*FACT_FIELDS, *TASK_FIELDS, "decisions"]} | {"aliases": F.to_json("aliases"), "update_history": F.to_json("update_history"), "schema_version": F.lit(str(VERSION))}
    value |= {c: F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)") for c in STRINGS}
    value["agent_instructions"] = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), a_list(f)) for f in AGENT_FIELDS]), F.lit("}"))
    flat = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), value[k]) for k in KEYS]), F.lit("}"))

    @F.pandas_udf("string")
    def indented(s: pd.Series) -> pd.Series:
        return s.map(lambda one: json_module.dumps(json_module.loads(one), ensure_ascii=False, indent=2) + "\n")

    ship(docs.sparkSession)
    return x.select("project", indented(flat).alias("content"))


def violations(items: DataFrame) -> DataFrame:
    """items: (project, field, pos, id, text, status, confidence, blocks and, if there is, evidence). (project, field, pos, rule) for each broken rule."""
    f, s = F.col("field"), F.col("status")
    allowed = F.when(f.isin(*TASK_FIELDS), s.isin(*TASK_FIELDS.values())).when(f == "decisions", s.isin("active", "superseded")).otherwise(s.isin("active", "superseded", "disputed"))
    bad_blocks = lambda b: b.isNull() | F.exists(b, lambda n: n.isNull() | (n <= 0)) | (F.size(b) != F.size(F.array_distinct(b)))
    rules = {
        "text": t.strip(F.coalesce(F.col("text"), F.lit(""))) == "", "id": ~F.coalesce(F.col("id").rlike("^[0-9a-f]{20}$"), F.lit(False)),
        "status": ~F.coalesce(allowed, F.lit(False)), "confidence": ~F.coalesce(F.col("confidence").isin("LOW", "MEDIUM", "HIGH"), F.lit(False)),
        "blocks": bad_blocks(F.col("blocks")),
        "unique_id": F.count("*").over(Window.partitionBy("project", "field", "id")) > 1, "field": ~f.isin(*FACT_FIELDS, *TASK_FIELDS, "decisions", *AGENT_FIELDS),
    }
    if "evidence" in items.columns:
        rules["evidence"] = F.col("evidence").isNull() | F.exists("evidence", lambda e: (F.coalesce(e["source"], F.lit("")) == "") | (F.coalesce(e["observed_at"], F.lit("")) == "") | bad_blocks(e["source_blocks"]))
    broken = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda r: r.isNotNull())
    return items.select("project", "field", "pos", broken.alias("broken")).select("project", "field", "pos", F.explode("broken").alias("rule"))


def must_be_valid(items: DataFrame) -> DataFrame:
    """items again; an error names the first broken rules. The barrier before anything is stored."""
    broken = violations(items).orderBy("project", "field", "pos").limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['project']}.{r['field']}[{r['pos']}]: {r['rule']}" for r in broken))
    return items


def metadata(status: Column, confidence: Column, blocks: Column) -> Column:
    """What stands behind an item: status, confidence, blocks, as far as they matter."""
    return F.concat_ws("; ", F.when(status.isin("superseded", "disputed"), F.concat(F.lit("status: "), status)), F.when(confidence.isin("LOW", "MEDIUM"), F.concat(F.lit("confidence: "), confidence)),
                       F.when(F.size(blocks) > 0, F.concat(F.lit("источник: блоки "), F.array_join(blocks.cast("array<string>"), ", "))))


def sections(items: DataFrame) -> DataFrame:
    """(project, field, body): the item lines of each list, in order."""
    meta = metadata(F.col("status"), F.col("confidence"), F.col("blocks"))
    line = F.concat(F.lit("- "), F.coalesce("text", F.lit(t.NEEDS_REVIEW)), F.when(meta != "", F.concat(F.lit(" — "), meta)).otherwise(""))
    g = items.withColumn("line", line).groupBy("project", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return g.select("project", "field", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def _sections(headings: dict[str, str]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"## {h}\n\n"), F.coalesce(F.element_at("bodies", k), F.lit(NO_DATA)), F.lit("\n")) for k, h in headings.items()])


def render(docs: DataFrame, items: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """docs: (project, display_name, summary, purpose, last_updated). Adds the files context, tasks, agents and decisions, a column each.

    decisions: items' columns with reason, date, previous.
    """
    bodies = sections(items).groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("field", "body"))).alias("bodies"))
    d = docs.join(bodies, "project", "left").withColumn("bodies", F.coalesce("bodies", F.create_map().cast("map<string,string>")))
    scalar = lambda h, c: F.concat(F.lit(f"## {h}\n\n"), F.when(t.strip(F.coalesce(c, F.lit(""))) != "", t.strip(F.col(c))).otherwise(UNDEFINED), F.lit("\n"))
    done = lambda c: F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit("\n"))
    name = F.when(F.coalesce("display_name", F.lit("")) != "", F.col("display_name")).otherwise(F.col("project"))
    stamp = F.concat(F.lit("## Обновление\n\nПоследнее обновление: "), F.coalesce("last_updated", F.lit("неизвестно")), F.lit("\n"))
    out = d.select("project", done(F.concat_ws("\n", F.concat(F.lit("# "), name, F.lit("\n")), scalar("Краткое описание", "summary"), scalar("Назначение", "purpose"), _sections(HEADINGS), stamp)).alias("context"),
                   done(F.concat(F.lit("# Задачи\n\n"), _sections(TASK_HEADINGS))).alias("tasks"), done(F.concat(F.lit("# Инструкции для AI coding-агента\n\n"), _sections(AGENT_HEADINGS))).alias("agents"))
    if decisions is None:
        return out
    when = F.when(F.coalesce("date", F.lit("")) != "", F.col("date")).otherwise("Дата не указана")
    given = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    meta = metadata(F.col("status"), F.col("confidence"), F.col("blocks"))
    block = F.concat(F.concat_ws("\n", F.concat(F.lit("## "), when, F.lit(" — "), "text", F.lit("\n")), given("Причина: ", "reason"), given("Предыдущее решение: ", "previous"),
                                 F.when(F.col("status") == "superseded", F.lit("Статус: заменено более поздним решением")), F.when(meta != "", meta)), F.lit("\n"))
    g = decisions.withColumn("block", block).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("l")).select("project", F.array_join(F.transform("l", lambda x: x["block"]), "\n").alias("blocks"))
    text = F.coalesce(done(F.concat(F.lit("# Решения\n\n"), F.col("blocks"))), F.lit("# Решения\n\nПока нет зафиксированных решений.\n"))
    return out.join(g, "project", "left").withColumn("decisions", text).drop("blocks")
