"""Every query by name: a function of (spark, sf_dir), and its SQL where SQL can express it.

Rule queries run over transcripts made by sources.synth from the whole events table (the SQL makes them alike);
structural ones over the whole conversations, documents or pages table. Rows hold plain columns; lists are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as t
from lorekeep.operators import chunk, document, extract, fold, reconcile, reduce
from lorekeep.plans import run
from lorekeep.sources import synth, transcripts
from lorekeep.sources.runtime import cut, ship

FLAGSHIP = "f5_line_status"
QUERIES: dict = {}
SQL: dict[str, str] = {}
LB, RB = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("history_id"), (F.col("turn") + 1).cast("int").alias("number"), "role", F.lit(None).cast("string").alias("date"), "text")


def projects(m: DataFrame) -> DataFrame:
    """The best candidate of each history, to run extraction on."""
    c = extract.candidates(m, ascii_only=False).where("rank = 1")
    return c.select("history_id", "project", "display_name", F.array().cast("array<string>").alias("aliases"), "message_numbers")


# ---- SQL parts, used by several queries
_M = "WITH RECURSIVE " + synth.messages_cte()
_FOLD = "replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ')"
_STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\x{{A0}}]+|[\s\x1c-\x1f\x{{85}}\x{{A0}}]+$', '', 'g')"
_LINES = r"""list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*[-*\d.)]+\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 8 AND 500)"""
_NAMES = r"""found AS (
  SELECT history_id, number, 0 AS pattern, unnest(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё][\p{L}\p{N}_-]{1,40}_[\p{L}\p{N}_.-]{2,60}')) AS raw, text FROM messages
  UNION ALL
  SELECT history_id, number, 1, unnest(regexp_extract_all(text, '(?i)(?:проект|project)\s*[«"'']?\s*[:—-]?\s*([A-Za-zА-Яа-яЁё][\p{L}\p{N}_.-]{2,60})', 1)), text FROM messages),
named AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(raw, '^[. ,''"»]+|[. ,''"»]+$', '', 'g')), '[\s-]+', '_', 'g'), '[^\p{L}\p{N}_.]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS project,
    regexp_replace(raw, '^[. ,''"»]+|[. ,''"»]+$', '', 'g') AS bare FROM found),
hits AS (SELECT * FROM named WHERE project <> '' AND NOT regexp_matches(project, '^(test_|memory_)') AND project NOT IN (""" + ", ".join(f"'{x}'" for x in t.GENERIC_NAMES) + r""")),
cands AS (
  SELECT history_id, project, list_sort(list_distinct(list(number))) AS numbers, count(*) AS occurrences, arg_min(bare, struct_pack(n := number, p := pattern)) AS bare FROM hits GROUP BY ALL),
ranked AS (
  SELECT history_id, project, numbers, occurrences,
    list_reduce(list_transform(string_split(replace(bare, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS display_name,
    row_number() OVER (PARTITION BY history_id ORDER BY occurrences DESC, project) AS rank FROM cands),
best AS (SELECT * FROM ranked WHERE rank = 1)"""
_REL = r""", marked AS (
  SELECT m.history_id, b.project, b.display_name, m.number, m.role, m.date, m.text,
    (list_contains(b.numbers, m.number) OR contains(replace(lower(m.text), '_', ' '), replace(lower(b.project), '_', ' ')) OR contains(replace(lower(m.text), '_', ' '), lower(b.display_name))) AS hit
  FROM messages m JOIN best b USING (history_id)),
rel AS (
  SELECT a.* EXCLUDE hit FROM marked a
  WHERE hit OR EXISTS (FROM marked p WHERE p.history_id = a.history_id AND p.project = a.project AND p.number = a.number - 1 AND p.hit)
    OR NOT EXISTS (FROM marked p WHERE p.history_id = a.history_id AND p.project = a.project AND p.hit))"""


#: rel with a row for each technology that a message names; constant patterns, as compiling one a row is slow.
_TECHS = ", techs_of AS (SELECT history_id, project, number, unnest(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{LB}{k}{RB}') THEN '{v}' END" for k, v in t.TECHNOLOGIES.items()) + "], lambda x: x IS NOT NULL))) AS label FROM rel)"


def _word(words: str) -> str:
    return f"regexp_matches(low, '{LB}({words}){RB}')"


_LINE = (
    _REL
    + f""", lined AS (
  SELECT history_id, project, display_name, number, date, i - 1 AS line_no, l[i] AS line, {_FOLD.format('l[i]')} AS low
  FROM (SELECT *, {_LINES} AS l FROM rel) x, generate_series(1, len(l)) AS g(i)),
classed AS (
  SELECT *, CASE WHEN {_word(t.COMPLETED)} THEN 'completed' WHEN {_word(t.BUG)} THEN 'bug' WHEN {_word(t.TODO)} THEN 'todo' WHEN {_word(t.IDEA)} THEN 'idea' END AS status,
    {_word(t.DECISION)} AS is_decision, {_word(t.CONSTRAINT)} AS is_constraint, contains(line, '?') AND {_word(t.QUESTION)} AS is_question FROM lined)"""
)
_KEY = f"array_to_string(regexp_extract_all(' ' || regexp_replace(regexp_replace(replace({_FOLD.format('{0}')}, 'ё', 'е'), '{LB}({t.STOP}){RB}', '\\1 \\3', 'g'), '{LB}({t.STOP}){RB}', '\\1 \\3', 'g'), '[\\p{{L}}\\p{{N}}_+#.]+'), ' ')"
_COLLAPSE = r"trim(regexp_replace(replace(" + _FOLD + r", 'ё', 'е'), '\s+', ' ', 'g'))"


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = synth.messages(spark, sf_dir)
    p = projects(m)
    return m, p, extract.relevant(m, p)


@query("p1_item_ids", f"SELECT conv_id AS history_id, turn, substr(sha256('message' || chr(0) || {_COLLAPSE.replace('{0}', 'text')}), 1, 20) AS item_id FROM conversations")
def p1(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("history_id"), "turn", t.stable_id(F.lit("message"), F.col("text")).alias("item_id"))


@query("p2_safe_names", _M + r""", x AS (SELECT history_id, number, regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[\s-]+', '_', 'g'), '[^\p{L}\p{N}_.]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS n FROM messages)
SELECT history_id, number, nullif(regexp_replace(substr(n, 1, 80), '[. ]+$', ''), '') AS name FROM x""")
def p2(spark, sf_dir):
    return synth.messages(spark, sf_dir).select("history_id", "number", t.safe_name(F.col("text")).alias("name"))


@query("p3_useful_lines", _M + f", x AS (SELECT history_id, number, {_LINES} AS l FROM messages) SELECT history_id, number, (i - 1)::INT AS line_no, l[i] AS line FROM x, generate_series(1, len(l)) AS g(i)")
def p3(spark, sf_dir):
    return synth.messages(spark, sf_dir).select("history_id", "number", F.posexplode(t.useful_lines(F.col("text"))).alias("line_no", "line"))


@query("p4_match_keys", _M + f"SELECT history_id, number, {_KEY.replace('{0}', 'text')} AS key FROM messages".replace("SELECT history_id", " SELECT history_id", 1))
def p4(spark, sf_dir):
    return synth.messages(spark, sf_dir).select("history_id", "number", t.match_key(F.col("text")).alias("key"))


_PAIRS = _M + f""", d AS (SELECT DISTINCT text FROM messages), k AS (SELECT text, {_KEY.replace('{0}', 'text')} AS key FROM d), tk AS (SELECT text, key, list_filter(list_distinct(string_split(key, ' ')), lambda x: x <> '') AS toks FROM k),
pairs AS (SELECT a.text AS left_text, b.text AS right_text, a.key AS ka, b.key AS kb, len(a.toks) AS na, len(b.toks) AS nb, len(list_intersect(a.toks, b.toks)) AS s FROM tk a JOIN tk b ON a.text < b.text)
"""


@query("p6_similar_pairs", _PAIRS + "SELECT left_text, right_text FROM pairs WHERE ka <> '' AND kb <> '' AND (ka = kb OR (s >= 2 AND (s / (na + nb - s) >= 0.75 OR (s = least(na, nb) AND abs(na - nb) <= 1))))")
def p6(spark, sf_dir):
    """Pairs by a join on shared tokens; two equal keys share one, and any other pair at least two."""
    x = synth.messages(spark, sf_dir).select("text").distinct().withColumn("key", t.match_key(F.col("text")))
    tok = x.select("text", "key", F.explode(t.tokens(F.col("key"))).alias("tok"))
    a, b = tok.select(F.col("text").alias("left_text"), F.col("key").alias("ka"), "tok"), tok.select(F.col("text").alias("right_text"), F.col("key").alias("kb"), "tok")
    met = a.join(b, "tok").where("left_text < right_text").groupBy("left_text", "right_text").agg(F.first("ka").alias("ka"), F.first("kb").alias("kb"), F.count("*").alias("shared"))
    return met.where(((F.col("shared") >= 2) | (F.col("ka") == F.col("kb"))) & t.similar(F.col("ka"), F.col("kb"))).select("left_text", "right_text")


@query("p8_technology_changes", _M + r""", x AS (SELECT history_id, number, regexp_extract(text, '(?i)(?:с|from)\s+([\p{L}\p{N}_.+#-]+)\s+(?:на|to)\s+([\p{L}\p{N}_.+#-]+)', ['a', 'b']) AS r FROM messages)
SELECT history_id, number, r.a AS old_name, r.b AS new_name FROM x WHERE r.a <> '' AND r.b <> ''""")
def p8(spark, sf_dir):
    m = synth.messages(spark, sf_dir).select(F.col("history_id").alias("project"), F.col("number").alias("pos"), "text", F.lit("").alias("previous"))
    return reconcile.technology_changes(m).select(F.col("project").alias("history_id"), F.col("pos").alias("number"), "old_name", "new_name")


@query("p12_message_sizes", "SELECT conv_id AS history_id, (turn + 1)::INT AS number, (length(text) + length(role) + 64)::BIGINT AS size FROM conversations")
def p12(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return c.select("history_id", "number", t.message_size(F.col("text"), F.col("role"), F.col("date")).cast("long").alias("size"))


@query("p20_secret_scan", r"""WITH x AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL
  SELECT 'e' || event_id, CASE event_id % 4 WHEN 0 THEN 'key sk-' || repeat('a', 24) WHEN 1 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 2 THEN 'C:\Users\me\file' ELSE 'C:\Users\Example\file' END FROM events)
SELECT id, 'private key' AS finding FROM x WHERE regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') UNION ALL
SELECT id, 'API key' FROM x WHERE regexp_matches(text, '\bsk-[A-Za-z0-9_-]{20,}\b') UNION ALL
SELECT id, 'personal path' FROM x WHERE regexp_matches(replace(text, ':\Users\Example\', ''), '[A-Za-z]:\\Users\\[^\\\s]+\\')""")
def p20(spark, sf_dir):
    made = F.element_at(F.array(F.lit("key sk-" + "a" * 24), F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.lit("C:\\Users\\me\\file"), F.lit("C:\\Users\\Example\\file")), (F.col("event_id") % 4 + 1).cast("int"))
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    return extract.secret_scan(extract.union([
        read(spark, sf_dir, "documents").select(ident("d", "doc_id"), "text"), read(spark, sf_dir, "pages").select(ident("p", "page_id"), F.col("html").alias("text")),
        read(spark, sf_dir, "events").select(ident("e", "event_id"), made.alias("text"))]))


@query("a1_project_candidates", _M + ", " + _NAMES + " SELECT history_id, project, display_name, array_to_string(numbers, ',') AS message_numbers, occurrences, CASE WHEN len(numbers) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, rank::INT AS rank FROM ranked")
def a1(spark, sf_dir):
    c = extract.candidates(synth.messages(spark, sf_dir))
    return c.withColumn("message_numbers", F.array_join(F.col("message_numbers").cast("array<string>"), ","))


@query("j1_relevant_messages", _M + ", " + _NAMES + _REL + " SELECT history_id, project, number, text FROM rel")
def j1(spark, sf_dir):
    return _flow(spark, sf_dir)[2].select("history_id", "project", "number", "text")


@query("f4_technologies", _M + ", " + _NAMES + _REL + _TECHS + " SELECT history_id, project, label, min(number) AS number FROM techs_of GROUP BY ALL")
def f4(spark, sf_dir):
    return extract.technologies(_flow(spark, sf_dir)[2])


@query("f5_line_status", _M + ", " + _NAMES + _LINE + " SELECT project, status, count(*) AS n FROM classed WHERE status IS NOT NULL GROUP BY ALL")
def f5(spark, sf_dir):
    return extract.lines(_flow(spark, sf_dir)[2]).where("status IS NOT NULL").groupBy("project", "status").agg(F.count("*").alias("n"))


@query("f7_extraction_items", _M + ", " + _NAMES + _LINE + _TECHS + f""", i AS (
  SELECT history_id, project, 'implemented' AS field, number, line_no, line AS text, NULL AS status, 'MEDIUM' AS confidence, NULL AS date FROM classed WHERE status = 'completed' UNION ALL
  SELECT history_id, project, 'tasks', number, line_no, line, status, 'MEDIUM', NULL FROM classed WHERE status IS NOT NULL UNION ALL
  SELECT history_id, project, 'decisions', number, line_no, line, NULL, 'HIGH', coalesce(date, '') FROM classed WHERE is_decision UNION ALL
  SELECT history_id, project, f, number, line_no, line, NULL, 'HIGH', NULL FROM classed, (VALUES ('constraints'), ('do_not_change')) AS v(f) WHERE is_constraint UNION ALL
  SELECT history_id, project, 'open_questions', number, line_no, '{t.NEEDS_REVIEW} ' || line, NULL, 'LOW', NULL FROM classed WHERE is_question UNION ALL
  SELECT history_id, project, 'technologies', min(number), -1, label, NULL, 'MEDIUM', NULL FROM techs_of GROUP BY history_id, project, label)
SELECT history_id, project, field, number, line_no::INT AS line_no, text, status, confidence, date FROM i""")
def f7(spark, sf_dir):
    _, _, rel = _flow(spark, sf_dir)
    return extract.items(extract.lines(rel), extract.technologies(rel))


@query("l1_summaries", _M + ", " + _NAMES + _LINE + f""", s AS (SELECT history_id, project, arg_min(line, struct_pack(a := number, b := line_no)) AS line FROM classed WHERE contains(low, lower(project)) OR contains(low, lower(display_name)) GROUP BY ALL)
SELECT b.history_id, b.project, coalesce(substr(s.line, 1, 500), '{t.NEEDS_REVIEW} Назначение проекта ' || b.display_name || ' не удалось надёжно определить.') AS summary FROM best b LEFT JOIN s USING (history_id, project)""")
def l1(spark, sf_dir):
    _, p, rel = _flow(spark, sf_dir)
    return extract.summaries(extract.lines(rel), p)


_PIECES = """pieces0 AS (SELECT conv_id AS history_id, (turn + 1)::INT AS number, role, text FROM conversations),
split(history_id, number, role, part, piece, rest) AS (
  SELECT history_id, number, role, -1, NULL::VARCHAR, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM pieces0 WHERE length(text) + length(role) + 64 > 1000
  UNION ALL
  SELECT history_id, number, role, part + 1, CASE WHEN length(rest) > 872 THEN regexp_replace(substr(rest, 1, place), '^\\s+|\\s+$', '', 'g') ELSE rest END, CASE WHEN length(rest) > 872 THEN regexp_replace(substr(rest, place + 1), '^\\s+|\\s+$', '', 'g') ELSE '' END
  FROM (SELECT *, CASE WHEN b < 436 THEN 872 ELSE b END AS place FROM (SELECT *, 871 - coalesce(nullif(least(coalesce(nullif(strpos(reverse(substr(rest, 1, 872)), chr(10)), 0), 9999), coalesce(nullif(strpos(reverse(substr(rest, 1, 872)), ' '), 0), 9999)), 9999), 9999) + 1 AS b FROM split WHERE rest <> ''))),
pieces AS (
  SELECT history_id, number, 0 AS part, role, text, length(text) + length(role) + 64 AS size FROM pieces0 WHERE length(text) + length(role) + 64 <= 1000
  UNION ALL SELECT history_id, number, part, role, piece, length(piece) + length(role) + 64 FROM split WHERE part >= 0 AND piece <> ''),
ordered AS (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY number, part) AS n FROM pieces),
packed(history_id, n, chunk, held) AS (
  SELECT history_id, n, 0, size FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.history_id, o.n, p.chunk + (p.held + o.size > 1000)::INT, CASE WHEN p.held + o.size > 1000 THEN o.size ELSE p.held + o.size END FROM packed p JOIN ordered o ON o.history_id = p.history_id AND o.n = p.n + 1)"""


@query("w2_chunk_packing", "WITH RECURSIVE " + _PIECES + " SELECT o.history_id, o.number, o.part::INT AS part, o.size::INT AS size, p.chunk::INT AS chunk, o.text FROM ordered o JOIN packed p USING (history_id, n)")
def w2(spark, sf_dir):
    parts = chunk.pieces(conversations(spark, sf_dir), 1000)
    return chunk.pack(parts, 1000).select("history_id", "number", "part", F.col("size").cast("int").alias("size"), "chunk", "text")


_OBS = _M + ", " + _NAMES + f""", ob AS (SELECT history_id % 50 AS project, CASE WHEN event_id2 % 3 = 0 THEN 'tasks' ELSE 'constraints' END AS field, history_id * 1000 + number AS pos, text,
  CASE WHEN event_id2 % 3 = 0 THEN ['todo', 'completed', ''][event_id2 % 3 + 1] ELSE ['active', 'superseded', 'active', 'active', 'disputed'][(history_id * 1000 + number) % 5 + 1] END AS status,
  ['LOW', 'MEDIUM', 'HIGH'][number % 3 + 1] AS confidence, [number, history_id % 7 + 1] AS blocks FROM (SELECT *, length(text) AS event_id2 FROM messages))"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = synth.messages(spark, sf_dir).withColumn("n", F.length("text")).withColumn("pos", F.col("history_id") * 1000 + F.col("number"))
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    task = F.col("n") % 3 == 0
    return m.select((F.col("history_id") % 50).alias("project"), F.when(task, "tasks").otherwise("constraints").alias("field"), "pos", "text",
                    F.when(task, "todo").otherwise(pick(["active", "superseded", "active", "active", "disputed"], F.col("pos") % 5)).alias("status"), pick(["LOW", "MEDIUM", "HIGH"], F.col("number") % 3).alias("confidence"),
                    F.array(F.col("number"), (F.col("history_id") % 7 + 1).cast("int")).alias("blocks"))


_G = "GROUP BY project, field, key"


@query("a4_chunk_reduce", _OBS + f""", k AS (SELECT *, {_COLLAPSE.replace('{0}', 'text')} AS key, CASE confidence WHEN 'LOW' THEN 0 WHEN 'HIGH' THEN 2 ELSE 1 END AS rank FROM ob)
SELECT project, field, key, min(pos) AS pos, arg_max(text, pos) AS text, CASE WHEN field = 'tasks' THEN arg_max(status, pos) WHEN bool_or(status = 'disputed') THEN 'disputed' WHEN bool_or(status = 'superseded') THEN 'superseded' ELSE arg_min(status, pos) END AS status,
  arg_max(confidence, struct_pack(r := rank, p := -pos)) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(blocks)))), ',') AS blocks FROM k WHERE key <> '' {_G}""")
def a4(spark, sf_dir):
    return reduce.reduce_items(_observed(spark, sf_dir)).withColumn("blocks", F.array_join(F.col("blocks").cast("array<string>"), ","))


#: Stored and new facts: of every third history they are stored. SQL keeps all stored rows and lets the last of a key take the new ones.
_FACTS = _OBS + f""", k AS (SELECT *, pos // 1000 % 3 = 0 AS is_old, {_KEY.replace('{0}', 'text')} AS key, CASE confidence WHEN 'LOW' THEN 0 WHEN 'HIGH' THEN 2 ELSE 1 END AS rank FROM ob WHERE field = 'constraints'),
slots AS (SELECT *, CASE WHEN is_old THEN row_number() OVER (PARTITION BY project, field, key ORDER BY is_old DESC, pos DESC) ELSE 1 END AS slot, NOT is_old AS fresh FROM k),
merged AS (SELECT project, field, key, slot, arg_min(pos, struct_pack(f := fresh, p := pos)) AS pos, bool_or(is_old) AS is_old, arg_min(text, struct_pack(f := fresh, p := pos)) AS text,
  coalesce(arg_max(status, struct_pack(f := fresh, p := pos)) FILTER (status <> 'active'), 'active') AS status, arg_max(confidence, struct_pack(r := rank, f := NOT fresh, p := -pos)) AS confidence,
  array_to_string(list_sort(list_distinct(flatten(list(blocks)))), ',') AS blocks, len(list_distinct(list(array_to_string(list_sort(list_distinct(blocks)), ','))))::INT AS n_evidence FROM slots GROUP BY project, field, key, slot)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _observed(spark, sf_dir).where("field = 'constraints'").withColumn("project", F.col("project").cast("string"))
    return reconcile.canonical(o, F.lit("events"), F.lit("2024-01-01T00:00:00")).withColumn("is_old", F.floor(F.col("pos") / 1000) % 3 == 0)


@query("a5_fact_merge", _FACTS + f""" SELECT project::VARCHAR AS project, field, key, pos, is_old, substr(sha256(field || chr(0) || {_COLLAPSE.replace('{0}', 'text')}), 1, 20) AS id, text, status, confidence, blocks, n_evidence FROM merged""")
def a5(spark, sf_dir):
    r = reconcile.merge_items(_facts(spark, sf_dir))
    return r.select("project", "field", t.match_key(F.col("text")).alias("key"), "pos", "is_old", "id", "text", "status", "confidence", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"), F.size("evidence").alias("n_evidence"))


_TECH = "CASE (event_id2 + number) % 5 WHEN 0 THEN 'Redis' WHEN 1 THEN 'SQLite' WHEN 2 THEN 'Postgres' WHEN 3 THEN 'Flask' ELSE 'MySQL' END"


@query("j9_technology_changes", _M + f""", m AS (SELECT *, length(text) AS event_id2, history_id * 1000 + number AS pos FROM messages),
tech AS (SELECT history_id AS project, {_TECH} AS text, min(pos) AS pos FROM m WHERE number <= 3 GROUP BY ALL),
ch AS (SELECT history_id AS project, pos, {_TECH} AS old_name, CASE (event_id2 * 3 + number) % 6 WHEN 0 THEN 'Redis' WHEN 1 THEN 'SQLite' WHEN 2 THEN 'Postgres' WHEN 3 THEN 'Flask' WHEN 4 THEN 'MySQL' ELSE 'Kafka' END AS new_name FROM m WHERE number > 3 AND number % 3 = 0),
names AS (SELECT project, lower(text) AS key, min(pos) AS born, true AS base FROM tech GROUP BY ALL UNION ALL
  SELECT project, lower(new_name), min(pos), false FROM ch c WHERE NOT EXISTS (FROM tech t WHERE t.project = c.project AND lower(t.text) = lower(c.new_name)) GROUP BY ALL)
SELECT n.project::VARCHAR AS project, n.key, CASE WHEN bool_or(lower(c.old_name) = n.key AND (n.base OR c.pos > n.born)) THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN bool_or(lower(c.new_name) = n.key) OR NOT n.base THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM names n LEFT JOIN ch c ON c.project = n.project GROUP BY n.project, n.key, n.base, n.born""".replace("names AS (", "born AS (").replace("FROM names n", "FROM born n"))
def j9(spark, sf_dir):
    """Technologies of a history's first messages, and every third later message as a change of one into another, chains and returns among them."""
    m = synth.messages(spark, sf_dir).withColumn("pos", F.col("history_id") * 1000 + F.col("number")).withColumn("n", F.length("text"))
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    name = pick(["Redis", "SQLite", "Postgres", "Flask", "MySQL"], (F.col("n") + F.col("number")) % 5)
    empty = [F.lit("").alias(c) for c in ("reason", "date", "previous")]
    rows = lambda d, text, f: d.select(F.col("history_id").cast("string").alias("project"), F.lit(f).alias("field"), "pos", text.alias("text"), F.lit("active").alias("status"), F.lit("MEDIUM").alias("confidence"), F.array("number").alias("blocks"), *empty)
    tech = reconcile.canonical(rows(m.where("number <= 3"), name, "technologies"), F.lit("events"), F.lit("t"))
    other = pick(["Redis", "SQLite", "Postgres", "Flask", "MySQL", "Kafka"], (F.col("n") * 3 + F.col("number")) % 6)
    says = F.concat(F.lit("we move from "), name, F.lit(" to "), other)
    d = reconcile.canonical(rows(m.where("number > 3 AND number % 3 = 0"), says, "decisions"), F.lit("events"), F.lit("t"))
    done = reconcile.apply_changes(reconcile.placed(reconcile.merge_items(tech)), reconcile.technology_changes(d))
    return done.select("project", t.match_key(F.col("text")).alias("key"), "status", "confidence")


@query("a8_scalar_reduce", _M + f""", s AS (SELECT history_id, number, CASE WHEN number % 4 = 0 THEN '' WHEN number % 3 = 0 THEN '{t.NEEDS_REVIEW} ' || text ELSE text END AS v FROM messages)
SELECT history_id, coalesce(arg_max(v, number) FILTER (v <> '' AND NOT starts_with(v, '{t.NEEDS_REVIEW}')), arg_max(v, number) FILTER (v <> ''), '') AS value FROM s GROUP BY ALL""")
def a8(spark, sf_dir):
    m = synth.messages(spark, sf_dir)
    v = F.when(F.col("number") % 4 == 0, "").when(F.col("number") % 3 == 0, F.concat(F.lit(t.NEEDS_REVIEW + " "), "text")).otherwise(F.col("text"))
    return reduce.reduce_scalars(m.select(F.col("history_id").alias("project"), F.col("number").alias("pos"), v.alias("value"))).withColumnRenamed("project", "history_id")


@query("a3_candidate_merge", _M + ", " + _NAMES + """, c AS (SELECT history_id % 20 AS chunk0, history_id AS chunk, project, display_name, numbers, CASE WHEN len(numbers) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM ranked)
SELECT project, arg_min(display_name, chunk) AS display_name, array_to_string(CASE WHEN count(*) = 1 THEN first(numbers) ELSE list_sort(list_distinct(flatten(list(numbers)))) END, ',') AS message_numbers, CASE WHEN bool_or(confidence = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM c GROUP BY project""")
def a3(spark, sf_dir):
    c = extract.candidates(synth.messages(spark, sf_dir)).select("project", F.col("history_id").alias("chunk"), "display_name", F.array("display_name").alias("aliases"), "message_numbers", "confidence")
    return reduce.reduce_candidates(c).select("project", "display_name", F.array_join(F.col("message_numbers").cast("array<string>"), ",").alias("message_numbers"), "confidence")


@query("f10_violations", _OBS + """, i AS (SELECT project, field, pos, CASE WHEN pos % 11 = 0 THEN 'bad' ELSE substr(sha256(text), 1, 20) END AS id, CASE WHEN pos % 13 = 0 THEN '' ELSE text END AS text, CASE WHEN field = 'tasks' THEN 'todo' ELSE status END AS status, CASE WHEN pos % 17 = 0 THEN 'SURE' ELSE confidence END AS confidence, blocks FROM ob),
f AS (SELECT * REPLACE (CASE WHEN field = 'tasks' THEN 'todo_tasks' ELSE field END AS field) FROM i), u AS (SELECT *, count(*) OVER (PARTITION BY project, field, id) AS same FROM f)
SELECT project, field, pos, unnest(list_filter([CASE WHEN text = '' THEN 'text' END, CASE WHEN NOT regexp_full_match(id, '[0-9a-f]{20}') THEN 'id' END, CASE WHEN field = 'todo_tasks' AND status NOT IN ('current','todo','idea','bug','completed') THEN 'status' END,
  CASE WHEN confidence NOT IN ('LOW','MEDIUM','HIGH') THEN 'confidence' END, CASE WHEN len(list_distinct(blocks)) <> len(blocks) THEN 'blocks' END, CASE WHEN same > 1 THEN 'unique_id' END], lambda x: x IS NOT NULL)) AS rule FROM u""")
def f10(spark, sf_dir):
    p = F.col("pos")
    o = _observed(spark, sf_dir).withColumn("id", F.when(p % 11 == 0, "bad").otherwise(F.substring(F.sha2("text", 256), 1, 20))).withColumn("text", F.when(p % 13 == 0, "").otherwise(F.col("text")))
    return document.violations(o.withColumn("field", F.when(F.col("field") == "tasks", "todo_tasks").otherwise(F.col("field"))).withColumn("confidence", F.when(p % 17 == 0, "SURE").otherwise(F.col("confidence"))))


@query("g2_migrate_dates", """WITH d AS (SELECT user_id AS project, list(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END ORDER BY ts, event_id) AS h, strftime(max(ts), '%Y-%m-%d') AS last_updated, (user_id % 3 + 1)::INT AS v FROM events GROUP BY user_id)
SELECT project, 3 AS schema_version, CASE WHEN v < 2 THEN coalesce(list_filter(h, lambda x: x <> '')[1], last_updated) ELSE '' END AS created_at, last_updated FROM d""")
def g2(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    e = read(spark, sf_dir, "events").withColumn("day", F.when(F.col("event_id") % 2 == 0, day).otherwise(""))
    g = e.groupBy(F.col("user_id").alias("project")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "day"))).alias("h"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_updated"))
    return document.migrate_dates(g.select("project", (F.col("project") % 3 + 1).cast("int").alias("schema_version"), F.lit("").alias("created_at"), "last_updated", F.transform("h", lambda x: x["day"]).alias("history_dates")))


@query("snk7_render_tasks", _OBS + f""", l AS (SELECT project, pos, '- ' || text || ' — ' || concat_ws('; ', CASE WHEN confidence IN ('LOW','MEDIUM') THEN 'confidence: ' || confidence END, 'источник: блоки ' || array_to_string(blocks, ', ')) AS line FROM ob WHERE field = 'tasks')
SELECT project, '# Задачи' || chr(10) || chr(10) || array_to_string(['## Сейчас в работе' || chr(10) || chr(10) || '{document.NO_DATA}' || chr(10), '## Осталось сделать' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10),
  '## Известные баги' || chr(10) || chr(10) || '{document.NO_DATA}' || chr(10), '## Идеи на потом' || chr(10) || chr(10) || '{document.NO_DATA}' || chr(10), '## Выполнено' || chr(10) || chr(10) || '{document.NO_DATA}' || chr(10)], chr(10)) AS tasks FROM l GROUP BY project""")
def snk7(spark, sf_dir):
    o = _observed(spark, sf_dir).where("field = 'tasks'").withColumn("field", F.lit("todo_tasks"))
    docs = o.select("project").distinct().select("project", *[F.lit("").alias(c) for c in ("display_name", "summary", "purpose", "last_updated")])
    return document.render(docs, o).select("project", "tasks")


_RAW = """raws AS (SELECT conv_id AS history_id, string_agg({0} || text, chr(10) || chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY conv_id)"""


def _raw(spark: SparkSession, sf_dir: str, head) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("m", F.concat(head, "text"))
    g = c.groupBy(F.col("conv_id").alias("history_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("l"))
    return g.select("history_id", F.array_join(F.transform("l", lambda x: x["m"]), "\n\n").alias("raw"))


@query("src4_plain_text", "SELECT conv_id AS history_id, (turn + 1)::INT AS number, trim(text) AS text, role, '2024-01-0' || (turn % 9 + 1) AS date FROM conversations")
def src4(spark, sf_dir):
    head = F.concat(F.lit("2024-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit(" "), F.initcap("role"), F.lit(": "))
    return transcripts.plain(_raw(spark, sf_dir, head))


@query("src5_markdown", "SELECT conv_id AS history_id, (turn + 1)::INT AS number, trim(text) AS text, role, NULL::VARCHAR AS date FROM conversations")
def src5(spark, sf_dir):
    head = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## "), F.initcap("role"))).otherwise(F.concat(F.lit("**"), F.upper("role"), F.lit(":**"))), F.lit("\n"))
    return transcripts.markdown(_raw(spark, sf_dir, head))


@query("src7_json_lines", "SELECT conv_id AS history_id, (turn + 1)::INT AS number, trim(text) AS text, role, NULL::VARCHAR AS date FROM conversations")
def src7(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("m", F.to_json(F.struct("role", F.col("text").alias("content"))))
    g = c.groupBy(F.col("conv_id").alias("history_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("l"))
    return transcripts.structured(g.select("history_id", F.array_join(F.transform("l", lambda x: x["m"]), "\n").alias("raw")), lines=True)


@query("src10_tree_branch", """WITH n AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)
SELECT conv_id AS history_id, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 5 = 0 THEN -turn ELSE turn END))::INT AS number, conv_id || '-' || turn AS node, text FROM n WHERE conv_id % 5 = 0 OR (top - turn) % 2 = 0""")
def src10(spark, sf_dir):
    """Each turn's parent is the turn two before it; every fifth history has no current node and is ordered by time, which runs backwards."""
    c = read(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    node = lambda x: F.concat_ws("-", F.col("conv_id").cast("string"), x.cast("string"))
    top = F.max("turn").over(Window.partitionBy("conv_id"))
    nodes = c.select(F.col("conv_id").alias("history_id"), node(F.col("turn")).alias("node"), node(F.col("turn") - 2).alias("parent"), F.col("turn").cast("int").alias("ord"),
                     (-F.col("turn")).cast("double").alias("create_time"), "text", ((F.col("turn") == top) & (F.col("conv_id") % 5 != 0)).alias("is_leaf"))
    return transcripts.tree(nodes)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of all histories by project, in order; those of the first half of each project's order are stored already."""
    _, _, rel = _flow(spark, sf_dir)
    pos = F.col("history_id") * 100_000 + F.col("number") * 100 + F.col("line_no")
    d = extract.lines(rel).where("is_decision").select("project", F.lit("decisions").alias("field"), pos.alias("pos"), F.col("line").alias("text"), F.lit("active").alias("status"), F.lit("HIGH").alias("confidence"), F.array("number").alias("blocks"),
                                                       F.lit("").alias("reason"), F.coalesce("date", F.lit("")).alias("date"), F.regexp_extract("line", reconcile.CHANGE, 1).alias("previous"))
    return reconcile.canonical(d, F.lit("events"), F.lit("2024-01-01T00:00:00")).withColumn("is_old", F.col("pos") % 100_000 % 700 < 100)


@query("j6_decision_fold")
def j6(spark, sf_dir):
    """Stored decisions, two and more of one text among them, stay as they are; new ones are folded in order."""
    out = fold.fold(_decisions(spark, sf_dir), "decisions")
    return out.select("project", "pos", "id", "text", "status", "date", "previous", F.size("evidence").alias("n_evidence"))


@query("j8_task_fold")
def j8(spark, sf_dir):
    """Tasks of all histories; one in seven messages' are stored already, in the list of their status."""
    _, _, rel = _flow(spark, sf_dir)
    pos = F.col("history_id") * 100_000 + F.col("number") * 100 + F.col("line_no")
    d = extract.lines(rel).where("status IS NOT NULL").select("project", F.lit("tasks").alias("field"), pos.alias("pos"), F.col("line").alias("text"), "status", F.lit("MEDIUM").alias("confidence"), F.array("number").alias("blocks"))
    x = reconcile.canonical(d, F.lit("events"), F.lit("2024-01-01T00:00:00")).withColumn("is_old", F.col("pos") % 100_000 % 700 < 100)
    lists = F.create_map(*[v for f, s in document.TASK_FIELDS.items() for v in (F.lit(s), F.lit(f))])
    out = fold.fold(x.withColumn("field", F.when(F.col("is_old"), lists[F.col("status")]).otherwise(F.col("field"))), "tasks")
    return out.select("project", "field", "pos", "id", "text", "status", F.size("evidence").alias("n_evidence"))


@query("src2_detect_format", "SELECT conv_id AS history_id, (turn + 1)::INT AS number, trim(text) AS text, role, CASE conv_id % 4 WHEN 3 THEN '2024-01-01' END AS date FROM conversations")
def src2(spark, sf_dir):
    """Histories written in four formats, told apart."""
    c = read(spark, sf_dir, "conversations")
    js = F.to_json(F.struct("role", F.col("text").alias("content")))
    m = F.when(F.col("conv_id") % 4 <= 1, js).when(F.col("conv_id") % 4 == 2, F.concat(F.lit("# "), "role", F.lit("\n"), "text")).otherwise(F.concat(F.lit("2024-01-01 ["), "role", F.lit("]: "), "text"))
    g = c.withColumn("m", m).groupBy(F.col("conv_id").alias("history_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("l"))
    k, parts = F.col("history_id") % 4, F.transform("l", lambda x: x["m"])
    raw = F.when(k == 0, F.concat(F.lit('{"messages":['), F.array_join(parts, ","), F.lit("]}"))).when(k == 1, F.array_join(parts, "\n")).otherwise(F.array_join(parts, "\n\n"))
    return transcripts.detect(g.select("history_id", raw.alias("raw")))


@query("p7_references", _PAIRS + """, refs AS (SELECT DISTINCT unnest(['SQLite', 'Flask', 'loader number', 'tests pytest', 'Docker image builds now', 'the parser later', 'checks nothing here']) AS ref), rk AS (SELECT ref, """ + _KEY.replace('{0}', 'ref') + """ AS key FROM refs), rt AS (SELECT ref, key, list_filter(list_distinct(string_split(key, ' ')), lambda x: x <> '') AS toks FROM rk),
m AS (SELECT t.text, r.ref, t.key AS ka, r.key AS kb, len(t.toks) AS na, len(r.toks) AS nb, len(list_intersect(t.toks, r.toks)) AS s FROM tk t, rt r WHERE t.key <> '' AND r.key <> '')
SELECT text, ref FROM m WHERE s = nb OR ka = kb OR (s >= 2 AND (s / (na + nb - s) >= 0.75 OR (s = least(na, nb) AND abs(na - nb) <= 1)))""")
def p7(spark, sf_dir):
    """Which texts a reference names: equal or similar keys, or all its tokens. All of these share a token, so an equi-join finds them."""
    refs = ["SQLite", "Flask", "loader number", "tests pytest", "Docker image builds now", "the parser later", "checks nothing here"]
    x = synth.messages(spark, sf_dir).select("text").distinct().withColumn("key", t.match_key(F.col("text")))
    r = spark.createDataFrame([(v,) for v in refs], "ref string").withColumn("ref_key", t.match_key(F.col("ref")))
    met = x.withColumn("tok", F.explode(t.tokens(F.col("key")))).join(F.broadcast(r.withColumn("tok", F.explode(t.tokens(F.col("ref_key"))))), "tok").select("text", "key", "ref", "ref_key").distinct()
    return met.where(t.refers(F.col("key"), F.col("ref_key"))).select("text", "ref")


@query("p6_spelled_pairs")
def p6_spelled(spark, sf_dir):
    """The last arm of the similarity rule: keys of as many tokens and nearly the same letters. Candidates share the number of tokens and a class of length (neighbouring classes differ by 11 to 9); SequenceMatcher, which SQL lacks, decides. The smaller text comes first."""
    x = synth.messages(spark, sf_dir).select("text").distinct().withColumn("key", t.match_key(F.col("text"))).where("key <> ''").withColumn("n", F.size(t.tokens(F.col("key"))))
    of_length = F.floor(F.log(F.length("key")) / F.log(F.lit(11 / 9))).cast("int")
    a = x.select(F.col("text").alias("left_text"), F.col("key").alias("ka"), "n", of_length.alias("c"))
    b = x.select(F.col("text").alias("right_text"), F.col("key").alias("kb"), "n", F.explode(F.array(of_length - 1, of_length, of_length + 1)).alias("c"))
    near = F.least(F.length("ka"), F.length("kb")) * 11 >= F.greatest(F.length("ka"), F.length("kb")) * 9
    return a.join(b, ["n", "c"]).where((F.col("left_text") < F.col("right_text")) & near).where(t.spelled("ka", "kb")).select("left_text", "right_text")


@query("p19_named_projects", _M + r""", l AS (SELECT history_id AS id, string_agg(CASE number % 4 WHEN 0 THEN ' River Mapper ' WHEN 1 THEN 'grid-sync' WHEN 2 THEN '' ELSE 'Tool ' || (number % 9) END, ',' ORDER BY number) AS names FROM messages GROUP BY history_id),
u AS (SELECT id, i - 1 AS pos, trim(p[i]) AS raw FROM (SELECT id, string_split(names, ',') AS p FROM l), generate_series(1, len(p)) AS g(i)),
n AS (SELECT id, pos, raw, regexp_replace(lower(raw), '[\s-]+', '_', 'g') AS project FROM u WHERE raw <> '')
SELECT id, project, pos::INT AS pos, raw AS display_name, 'HIGH' AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY id, project ORDER BY pos) = 1""")
def p19(spark, sf_dir):
    m = synth.messages(spark, sf_dir)
    name = F.when(F.col("number") % 4 == 0, " River Mapper ").when(F.col("number") % 4 == 1, "grid-sync").when(F.col("number") % 4 == 2, "").otherwise(F.concat(F.lit("Tool "), (F.col("number") % 9).cast("string")))
    g = m.groupBy(F.col("history_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("number", name.alias("n")))).alias("l"))
    return reduce.names_from_list(g.select("id", F.array_join(F.transform("l", lambda x: x["n"]), ",").alias("names")))


@query("a12_tally", "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'stored' END AS status, count(*) AS n FROM events GROUP BY ALL")
def a12(spark, sf_dir):
    return reduce.tally(read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("stored").alias("status")))


@query("src8_nested_json", "SELECT conv_id AS history_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS number, trim(text) AS text, role, CASE conv_id % 5 WHEN 1 THEN '2024-01-01' WHEN 4 THEN strftime(make_timestamp((1700000000 + turn * 60)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS date FROM conversations WHERE trim(text) <> ''")
def src8(spark, sf_dir):
    """Histories in five shapes: lists in lists, an empty list before the one that counts, authors, senders with parts, a tree with times."""
    c = read(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") % 5)
    text, role = F.col("text"), F.col("role")
    parts = F.struct(F.array(F.lit(""), text).alias("parts"))
    one = F.when(F.col("k") == 0, F.to_json(F.struct("role", text.alias("content")))).when(F.col("k") == 1, F.to_json(F.struct("role", "text", F.lit(" 2024-01-01 ").alias("date")))).when(F.col("k") == 2, F.to_json(F.struct(F.struct("role").alias("author"), parts.alias("content"))))
    one = one.when(F.col("k") == 3, F.to_json(F.struct(role.alias("sender"), F.array(text).alias("parts")))).otherwise(
        F.concat(F.lit('"n'), F.col("turn").cast("string"), F.lit('":'), F.to_json(F.struct(F.when(F.col("turn") > 0, F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))).alias("parent"), F.struct(F.struct("role").alias("author"), "text", (1_700_000_000 + F.col("turn") * 60).alias("create_time")).alias("message")))))
    g = c.withColumn("m", one).groupBy(F.col("conv_id").alias("history_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("l"), F.max("turn").alias("top"))
    k, inner = F.col("history_id") % 5, F.array_join(F.transform("l", lambda x: x["m"]), ",")
    wrap = lambda a, b: F.concat(F.lit(a), inner, F.lit(b))
    raw = F.when(k == 0, wrap("[[[", "]],[]]")).when(k == 1, wrap('{"messages":[],"items":[', "]}")).when(k == 2, wrap('{"data":{"conversation":[', ']},"items":[]}')).when(k == 3, wrap('[{"chat_messages":[', "]}]"))
    raw = raw.otherwise(F.concat(F.lit('{"current_node":"n'), F.col("top").cast("string"), F.lit('","mapping":{'), inner, F.lit("}}")))
    return transcripts.structured(g.select("history_id", raw.alias("raw")))


_ANSWERS = """answers AS (SELECT event_id AS id, event_id % 5 AS k, concat('{"summary":" sum ', event_id, ' ","technologies":["tool ', event_id % 7, ' ",{"title":"made ', event_id % 3, '","confidence":"', ['low', 'HIGH', 'sure'][event_id % 3 + 1], '","source_blocks":[', event_id % 4, ',"2",-1,true,2],"status":"', ['active', 'odd'][event_id % 2 + 1], '"},5,""],"decisions":["plain",{"text":"d","status":"superseded","reason":"r"}],"tasks":["no",{"title":" do ","status":"', ['BUG', 'other'][event_id % 2 + 1], '"}],"agent_instructions":{"rules":["be brief"]}}') AS j FROM events)"""


@query("p16_sanitised_answers", "WITH " + _ANSWERS + """
SELECT id, 'technologies' AS field, 0::BIGINT AS pos, 'tool ' || id % 7 AS text, NULL AS status, NULL AS confidence, '' AS blocks, NULL AS reason FROM answers UNION ALL
SELECT id, 'technologies', 1, 'made ' || id % 3, CASE WHEN id % 2 = 0 THEN 'active' END, ['LOW', 'HIGH', 'MEDIUM'][id % 3 + 1], CASE id % 4 WHEN 0 THEN '2' WHEN 2 THEN '2' ELSE (id % 4) || ',2' END, NULL FROM answers UNION ALL
SELECT id, 'decisions', 0, 'plain', NULL, 'MEDIUM', '', '' FROM answers UNION ALL SELECT id, 'decisions', 1, 'd', NULL, 'MEDIUM', '', 'r' FROM answers UNION ALL
SELECT id, 'tasks', 1, 'do', CASE WHEN id % 2 = 0 THEN 'bug' ELSE 'todo' END, 'MEDIUM', '', NULL FROM answers UNION ALL SELECT id, 'rules', 0, 'be brief', NULL, NULL, '', NULL FROM answers""")
def p16(spark, sf_dir):
    """A model's answers, every second in a code fence, made into items."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2).alias("even"))
    n = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    j = F.concat(F.lit('{"summary":" sum '), n.cast("string"), F.lit(' ","technologies":["tool '), (n % 7).cast("string"), F.lit(' ",{"title":"made '), (n % 3).cast("string"), F.lit('","confidence":"'), pick(["low", "HIGH", "sure"], n % 3), F.lit('","source_blocks":['), (n % 4).cast("string"),
                 F.lit(',"2",-1,true,2],"status":"'), pick(["active", "odd"], n % 2), F.lit('"},5,""],"decisions":["plain",{"text":"d","status":"superseded","reason":"r"}],"tasks":["no",{"title":" do ","status":"'), pick(["BUG", "other"], n % 2), F.lit('"}],"agent_instructions":{"rules":["be brief"]}}'))
    _, items = document.sanitise(e.select(n.alias("id"), F.when(F.col("even") == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).otherwise(j).alias("content")))
    return items.select("id", "field", "pos", "text", "status", "confidence", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"), "reason")


@query("g3_migrated_items", """SELECT 'p' || event_id AS project, 'technologies' AS field, 0::BIGINT AS pos, substr(sha256('technologies' || chr(0) || 'tool ' || event_id % 7), 1, 20) AS id, 'Tool ' || event_id % 7 AS text, 'active' AS status, 'MEDIUM' AS confidence FROM events UNION ALL
SELECT 'p' || event_id, 'known_bugs', 0, substr(sha256('tasks' || chr(0) || 'bug ' || event_id % 5), 1, 20), 'bug ' || event_id % 5, CASE WHEN event_id % 3 = 0 THEN 'todo' ELSE 'bug' END, CASE WHEN event_id % 2 = 0 THEN 'LOW' ELSE 'MEDIUM' END FROM events UNION ALL
SELECT 'p' || event_id, 'rules', 0, substr(sha256('agent_instructions.rules' || chr(0) || 'brief'), 1, 20), 'brief', 'active', 'MEDIUM' FROM events""")
def g3(spark, sf_dir):
    """Stored documents of versions 1 and 2 with items of both old forms, read as version 3."""
    n = F.col("event_id")
    doc = F.concat(F.lit('{"schema_version":'), (n % 2 + 1).cast("string"), F.lit(',"project":"p'), n.cast("string"), F.lit('","technologies":["Tool '), (n % 7).cast("string"), F.lit('"],"known_bugs":[{"text":"bug '), (n % 5).cast("string"), F.lit('","confidence":"'), F.when(n % 2 == 0, "low").otherwise("odd"),
                   F.lit('","status":"'), F.when(n % 3 == 0, "todo").otherwise("none"), F.lit('"}],"agent_instructions":{"rules":[" brief "]}}'))
    # few bytes and much work each, so a file that Spark reads in one task or two is dealt out first
    e = read(spark, sf_dir, "events").select("event_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    items = document.read_documents(e.select(F.concat(F.lit("p"), n.cast("string")).alias("project"), doc.alias("content")))[1]
    return items.select("project", "field", "pos", "id", "text", "status", "confidence")


_X7 = _M + ", " + _NAMES + _LINE + _TECHS + rf""", batch AS (SELECT history_id, project, number <= 20 AS first_run, number, line, line_no, low, status, is_decision, is_constraint, is_question FROM classed),
named_techs AS (SELECT history_id, project, lower(label) AS key FROM techs_of),
changed AS (SELECT history_id, project, lower(r.b) AS key FROM (SELECT history_id, project, regexp_extract(line, '(?i)(?:с|from)\s+([\p{{L}}\p{{N}}_.+#-]+)\s+(?:на|to)\s+([\p{{L}}\p{{N}}_.+#-]+)', ['a', 'b']) AS r FROM batch WHERE is_decision) WHERE r.a <> '' AND r.b <> ''),
techs AS (SELECT history_id, project, count(DISTINCT key) AS n FROM (FROM named_techs UNION ALL FROM changed) GROUP BY ALL),
keyed AS (SELECT history_id, project, {_KEY.replace('{0}', 'line')} AS key, status = 'completed' AS done, is_constraint, is_question FROM batch),
counts AS (SELECT history_id, project, count(DISTINCT key) FILTER (done) AS n_implemented, count(DISTINCT key) FILTER (is_constraint) AS n_constraints, count(DISTINCT key) FILTER (is_question) AS n_questions FROM keyed GROUP BY ALL),
runs AS (SELECT history_id, project, min(number) <= 20 AS a, max(number) > 20 AS b FROM rel GROUP BY ALL)
SELECT r.history_id || '.' || r.project AS project, b.display_name, CASE WHEN r.a THEN 'first summary' ELSE '' END AS summary, CASE WHEN r.b THEN 'second purpose' ELSE '' END AS purpose, CASE WHEN r.a THEN '2024-01-01' ELSE '2024-02-02' END AS created_at, CASE WHEN r.b THEN '2024-02-02' ELSE '2024-01-01' END AS last_updated,
  CASE WHEN r.a AND r.b THEN 'create,update' ELSE 'create' END AS modes, CASE WHEN r.a AND r.b THEN 'one,two' WHEN r.a THEN 'one' ELSE 'two' END AS aliases, coalesce(n_implemented, 0)::BIGINT AS n_implemented, coalesce(n_constraints, 0)::BIGINT AS n_constraints, coalesce(n_questions, 0)::BIGINT AS n_questions, coalesce(t.n, 0)::BIGINT AS n_technologies
FROM runs r JOIN best b USING (history_id, project) LEFT JOIN counts c USING (history_id, project) LEFT JOIN techs t USING (history_id, project)"""


@query("x7_documents", _X7)
def x7(spark, sf_dir):
    """Two runs, each over its part of every history's relevant messages: the second finds what the first made."""
    m = synth.messages(spark, sf_dir)
    p = cut(projects(m), "projects")  # searching all messages for names is dear, and both runs ask for projects again and again
    key = F.concat_ws(".", F.col("history_id").cast("string"), "project")
    rel = cut(extract.relevant(m, p), "relevant")
    found = cut(run.long_items(extract.items(extract.lines(rel), extract.technologies(rel)).withColumn("project", key)), "found")
    parts = (F.lit(1), F.lit(20)), (F.lit(21), F.lit(1 << 30))
    seen = rel.groupBy(key.alias("project")).agg(*[F.max(F.col("number").between(*part)).alias(f"in_{i}") for i, part in enumerate(parts)])
    names = cut(p.withColumn("project", key).select("project", "display_name").join(seen, "project"), "names")
    docs = items = None
    for i, (part, alias, summary, purpose, day) in enumerate(((parts[0], "one", "first summary", f"{t.NEEDS_REVIEW} not sure", "2024-01-01"), (parts[1], "two", f"{t.NEEDS_REVIEW} unclear", "second purpose", "2024-02-02"))):
        there = names.where(f"in_{i}")
        c = there.select("project", "display_name", F.array(F.lit(alias)).alias("aliases"))
        scalars = there.select("project", F.lit(summary).alias("summary"), F.lit(purpose).alias("purpose"))
        new = reconcile.reconcile(docs, items, c, scalars, found.where(F.element_at("blocks", 1).between(*part)), alias, day)
        new = [cut(x, "x7") for x in new]
        docs, items = new if docs is None else [n.unionByName(o.join(c.select("project"), "project", "left_anti")) for n, o in zip(new, (docs, items))]
    n = items.groupBy("project").agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f"n_{a}") for f, a in (("implemented", "implemented"), ("constraints", "constraints"), ("open_questions", "questions"), ("technologies", "technologies"))])
    d = docs.join(n, "project", "left").na.fill(0)
    return d.select("project", "display_name", "summary", F.when(F.col("purpose").startswith(t.NEEDS_REVIEW), "").otherwise(F.col("purpose")).alias("purpose"), "created_at", "last_updated", F.array_join(F.transform("update_history", lambda e: e["mode"]), ",").alias("modes"), F.array_join("aliases", ",").alias("aliases"), *[c for c in n.columns if c != "project"])
