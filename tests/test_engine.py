"""Golden cases for what SQL can't express: formats, folds, storage, names."""

import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as t
from lorekeep.operators import chunk, document, extract, fold, reconcile, reduce
from lorekeep.sources import transcripts
from lorekeep.sources.store import Stale, Store


def raw(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "history_id long, raw string")


def rows(df):
    return [tuple(r) for r in df.orderBy("history_id", "number").select("number", "text", "role", "date").collect()]


def test_plain(spark):
    got = rows(transcripts.plain(raw(spark, "User: one\n\nAssistant: two\n\n2024-05-06 Codex - three\n \nsystem:\n\njust text")))
    assert got == [(1, "one", "user", None), (2, "two", "assistant", None), (3, "three", "assistant", "2024-05-06"), (4, "", "system", None), (5, "just text", None, None)]


def test_markdown(spark):
    got = rows(transcripts.markdown(raw(spark, "lost\n## User\na\n\nb\n**Ассистент:**\nc\n# system:\n\n")))
    assert got == [(1, "a\n\nb", "user", None), (2, "c", "assistant", None)]


def test_json_shapes():
    p = lambda x: transcripts.parse_json(json.dumps(x), False)
    assert p({"messages": [{"role": "human", "content": "a", "timestamp": "d"}, {"author": {"role": "assistant"}, "content": {"parts": ["x", "y"]}}]}) == [(1, "a", "human", "d", None), (2, "x\n\ny", "assistant", None, None)]
    assert p({"chat_messages": [{"sender": "bot", "text": "t", "created_at": 1700000000}]}) == [(1, "t", "bot", None, 1.7e9)]
    node = lambda parent, text: {"parent": parent, "message": {"author": {"role": "user"}, "content": {"parts": [text]}}}
    tree = {"a": node(None, "1"), "b": node("a", "2"), "c": node("a", "other")}
    texts = lambda x: [m[1] for m in p(x)]
    assert texts({"current_node": "b", "mapping": tree}) == ["1", "2"]
    assert texts({"mapping": {"b": node("a", "2"), "a": node("b", "1")}, "current_node": "b"}) == ["1", "2"]  # a cycle
    assert texts({"mapping": tree}) == ["1", "2", "other"] == texts({"mapping": tree, "current_node": "gone"})
    assert texts({"mapping": {"a": None, "b": node("a", "x")}, "current_node": "a"}) == []  # a current node that is no object
    assert texts({"mapping": {}, "messages": [{"role": "user", "text": "x"}]}) == []  # a mapping wins
    times = {"a": node(None, "late"), "b": node(None, "early"), "c": node(None, "none"), "d": node(None, "same")}
    for k, at in (("a", 9), ("b", 1.5), ("c", True), ("d", 1.5)):
        times[k]["message"]["create_time"] = at
    assert texts({"mapping": times}) == ["early", "same", "late", "none"]
    assert p([{"role": None, "sender": "user", "text": "x", "date": None, "timestamp": "t"}]) == [(1, "x", None, None, None)]
    assert texts({"messages": [], "items": [[{"role": "u", "text": "i"}]], "data": [{"role": "u", "text": "d"}]}) == ["i"]
    assert texts([{"message": {"text": "no role"}}, {"text": "no role"}, {"role": "u", "content": ["", {"text": " a "}, [{"parts": ["b"], "text": "c"}], 5]}]) == ["no role", "a\n\nb"]
    for depth, ok in ((64, True), (65, False)):
        deep = {"role": "user", "content": "x"}
        for _ in range(depth):
            deep = [deep]
        if ok:
            assert texts(deep) == ["x"]
        else:
            with pytest.raises(ValueError):
                p(deep)
    with pytest.raises(ValueError):
        transcripts.parse_json("[" * 90 + "]" * 90, False)


def test_times(spark):
    df = spark.createDataFrame([(1.7e9,), (0.25,), (-1.5,), (1e15,), (None,)], "at double")
    want = ["2023-11-14T22:13:20+00:00", "1970-01-01T00:00:00.250000+00:00", "1969-12-31T23:59:58.500000+00:00", None, None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", z)
        assert [r[0] for r in df.select(transcripts.iso_time(F.col("at"))).collect()] == want
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_deep_tree(spark):
    """A branch of 700 nodes, one that runs into a cycle, and a history without a current node."""
    rows = [(1, str(i), str(i - 1), i, None, f"t{i}" if i % 2 else None, i == 699) for i in range(700)]
    rows += [(2, "a", "c", 0, None, "a", False), (2, "b", "a", 1, None, "b", False), (2, "c", "b", 2, None, "c", True), (2, "d", "a", 3, None, "d", False)]
    rows += [(3, "x", None, 0, 2.0, "x", False), (3, "y", "x", 1, 1.0, "y", False), (3, "z", "x", 2, None, "z", False)]
    got = transcripts.tree(spark.createDataFrame(rows, "history_id long, node string, parent string, ord int, create_time double, text string, is_leaf boolean")).orderBy("history_id", "number").collect()
    of = lambda h: [r["text"] for r in got if r["history_id"] == h]
    assert of(1) == [f"t{i}" for i in range(1, 700, 2)] and of(2) == ["a", "b", "c"] and of(3) == ["y", "x", "z"]


def test_detect_and_strict(spark):
    got = transcripts.detect(raw(spark, '{"messages":[{"role":"user","text":"j"}]}', '{"role":"user","text":"l1"}\n{"role":"bot","text":"l2"}', "# user\nm", "p", "{broken"))
    assert {r["history_id"]: r["text"] for r in got.where("number = 1").collect()} == {0: "j", 1: "l1", 2: "m", 3: "p", 4: "{broken"}
    with pytest.raises(Exception, match="line 2"):
        transcripts.structured(raw(spark, '{"role":"user","text":"x"}\n{'), lines=True, strict=True).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Пользователь: привет".encode("cp1251"))
    (tmp_path / "b.json").write_bytes(b'\xef\xbb\xbf[{"role":"user","content":"bom"}]')
    (tmp_path / "c.md").write_text("no marker here")
    assert sorted(r["text"] for r in transcripts.read_histories(spark, str(tmp_path)).collect()) == ["bom", "no marker here", "привет"]
    (tmp_path / "d.txt").write_bytes(b"user: \x98\xff")
    with pytest.raises(Exception, match="encoding"):
        transcripts.read_histories(spark, str(tmp_path)).collect()


def test_names(spark):
    df = spark.createDataFrame([("  My  Cool-App ",), ("CON",), ("...",), ("a" * 79 + "..b",), ("ﬁne_ß",)], "x string")
    got = [r[0] for r in df.select(t.safe_name(F.col("x"))).collect()]
    assert got == ["my_cool_app", "project_con", None, "a" * 79, "fine_ß"]
    assert spark.range(1).select(t.title(F.lit("telegram-bot v2.alpha_x"))).first()[0] == "Telegram-Bot V2.Alpha X"
    assert spark.range(1).select(t.match_key(F.lit("Надо добавить  Ёлку, done."))).first()[0] == "елку ."


def test_chunks(spark):
    with pytest.raises(ValueError):
        chunk.check(999)
    m = spark.createDataFrame([(1, 1, "a", None, "x" * 700), (1, 2, "a", None, " ".join(["word"] * 400))], "history_id long, number int, role string, date string, text string")
    got = chunk.pack(chunk.pieces(m, 1000), 1000).orderBy("number", "part").collect()
    assert len({r["chunk"] for r in got}) >= 3 and " ".join(r["text"] for r in got if r["number"] == 2) == " ".join(["word"] * 400)
    assert max(r["size"] for r in got) <= 1000


def item(pos, text, status="active", conf="MEDIUM", blocks=(1,), **more):
    return {"project": "p", "field": "decisions", "pos": pos, "is_old": False, "text": text, "status": status, "confidence": conf, "blocks": list(blocks), "id": text, "evidence": [{"source": "s", "source_blocks": list(blocks), "observed_at": "o"}], "reason": "", "date": "", "previous": ""} | more


ITEMS = "project string, field string, pos long, is_old boolean, id string, text string, status string, confidence string, blocks array<int>, evidence array<struct<source:string,source_blocks:array<int>,observed_at:string>>, reason string, date string, previous string"


def table(spark, *rows_):
    return spark.createDataFrame([tuple(r[c] for c in reconcile.ITEM) for r in rows_], ITEMS)


def test_task_fold():
    a = item(0, "write the csv loader module", "todo", is_old=True, field="todo_tasks")
    out = fold.fold_tasks([a, item(1, "write the csv loader module done", "completed", blocks=(7,))])
    assert len(out) == 1 and out[0]["status"] == "completed" and out[0]["field"] == "completed_tasks" and out[0]["id"] == a["id"] and len(out[0]["evidence"]) == 2 and out[0]["blocks"] == [1, 7]
    assert len(fold.fold_tasks([item(0, "alpha beta one", "todo"), item(1, "alpha beta two", "todo")])) == 2
    old = [item(0, "fix the csv loader module", "idea", is_old=True, field="ideas", id="x"), item(0, "fix the csv loader module", "todo", is_old=True, field="todo_tasks", id="y")]
    assert [t_["id"] for t_ in fold.fold_tasks([*old])] == ["y", "x"]  # stored ones stay, alike or not
    (one,) = fold.fold_tasks([*old, item(1, "fix the csv loader module", "bug")])
    assert (one["id"], one["status"], one["field"]) == ("y", "bug", "known_bugs")


def test_decision_fold():
    out = fold.fold_decisions([item(0, "use the sqlite file store"), item(1, "use the postgres store", previous="sqlite store"), item(2, "use the postgres store", reason="why", blocks=(5,))])
    assert [d["status"] for d in out] == ["superseded", "active"] and out[1]["reason"] == "why" and out[1]["blocks"] == [1, 5]
    old = [item(i, "use the sqlite file store", is_old=True, previous="nothing of that", id=str(i)) for i in range(2)]
    out = fold.fold_decisions([*old, item(2, "use the sqlite file store", blocks=(9,))])
    assert [(d["id"], d["status"], d["blocks"]) for d in out] == [("0", "active", [1, 9]), ("1", "active", [1])]


def test_fold_rejects_short_overlap():
    assert fold.Probe("abcdefghij klm").like(fold.Probe("abcdefghij kln"))
    assert not fold.Probe("").like(fold.Probe("x"))


def test_fold_index_equals_all_pairs():
    import random

    rng = random.Random(4)
    words = ["write", "the", "csv", "loader", "module", "loaders", "modules", "writes", "done", "fix", "parser", "parsers"]
    texts_ = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(300)]
    kept = fold.Kept()
    for n, x in enumerate(texts_):
        mine = fold.Probe(x)
        assert kept.like(mine) == {k for k in range(n) if fold.Probe(texts_[k]).like(mine)}
        kept.add(n, mine)


def test_fold_compares_keys_not_rows(monkeypatch):
    """Copies cost no comparison each, stored ones and ones that are named by a reference too."""
    calls = []
    for name in ("shares", "named_by"):
        monkeypatch.setattr(fold.Probe, name, lambda *a, _own=getattr(fold.Probe, name): calls.append(1) or _own(*a))
    stored = [item(i, "use the sqlite file store", is_old=True, id=f"o{i}") for i in range(300)]
    new = [item(300 + i, "use the sqlite file store", blocks=(i + 2,)) for i in range(300)] + [item(700 + i, f"now postgres plan {'abcde'[i % 5]}", previous="sqlite file") for i in range(300)]
    out = fold.fold_decisions([*stored, *new])
    assert out[0]["blocks"] == list(range(1, 302)) and len(out[0]["evidence"]) == 301 and {r["status"] for r in out[:300]} == {"superseded"} and len(out) == 301
    stored = [item(i, "fix the csv loader module", "todo", is_old=True, field="todo_tasks", id=f"o{i}") for i in range(300)]
    (one,) = fold.fold_tasks([*stored, *[item(300 + i, "fix the csv loader module", "bug", blocks=(i + 2,)) for i in range(300)]])
    assert (one["id"], one["status"], one["blocks"]) == ("o0", "bug", list(range(1, 302))) and len(calls) < 100


def test_fold_of_projects(spark):
    """Small projects share a task; each is folded alone and in order, whatever the order of its rows, and nulls come through."""
    import random

    rng = random.Random(5)
    made = [item(i, rng.choice(["use the sqlite file store", "use the sqlite file", "now postgres", ""]), rng.choice(["active", "disputed"]), is_old=i < 10, project=f"p{p}", blocks=(i % 7 + 1,), previous=rng.choice(["", "sqlite"]), reason=rng.choice(["", None])) for p in range(30) for i in range(20)]
    want = {(p, n): r for p in {r["project"] for r in made} for n, r in enumerate(fold.fold_decisions([dict(r) for r in made if r["project"] == p]))}
    got = fold.fold(table(spark, *rng.sample(made, len(made))), "decisions").collect()
    assert len(got) == len(want)
    for r in got:
        own = want[r["project"], r["pos"]]
        assert r.asDict(True) == {c: own[c] for c in r.asDict()} | {"pos": r["pos"]}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_lines_are_made_once(spark):
    """The optimizer copies a column to each place that names it; a name's patterns and a line's folding must not be copied."""
    m = spark.createDataFrame([(1, 1, "user", None, "text")], "history_id long, number int, role string, date string, text string")
    p = plan(extract.candidates(m))
    assert p.count(r"[^\w.]") == 1 and p.count("own(") == 1
    rel = m.select("*", F.lit("p").alias("project"), F.lit("P").alias("display_name"))
    assert plan(extract.lines(rel).where("status IS NOT NULL").select("status", "low")).count("lower(") == 1


def test_mentions_of_odd_names(spark):
    texts = ["Project: Aｌｐｈａ２ and проект «ἀτλ_ας», x_test_1", "project: con project: lpt1. memory_json test_abc my_tool. my_tool-2_b", "no names", "PROJECT - ʼnab_c and ǅabc_d_", "project 'x..' project: ___ab", None, ""]
    m = spark.createDataFrame(list(enumerate(texts)), "history_id long, text string").withColumn("number", F.lit(1))
    found = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_extract_all("text", F.lit(x), 1).alias("hits")) for i, x in enumerate((extract.IDENTIFIER, extract.NAMED))])
    raws = m.select("history_id", F.explode(found).alias("f")).select("history_id", "f.pattern", F.posexplode("f.hits").alias("place", "raw")).collect()
    want = []
    for r in raws:
        raw_ = re.sub(r"""^[. ,'"»]+|[. ,'"»]+$""", "", r["raw"])
        x = unicodedata.normalize("NFKC", raw_).strip().lower()
        x = re.sub(r"^[._]+|[._]+$", "", re.sub(r"[^\w.]", "", re.sub(r"[\s-]+", "_", x)))
        x = "project_" + x if x in t.RESERVED_NAMES else x
        x = re.sub(r"[. ]+$", "", x[:80])
        if x and x not in t.GENERIC_NAMES and not re.match("test_|memory_", x):
            want.append((r["history_id"], r["pattern"], r["place"], raw_, x))
    got = [tuple(r) for r in extract.mentions(m).select("history_id", "pattern", "place", "raw", "name").collect()]
    assert sorted(got) == sorted(want) and {"alpha2", "project_con", "project_lpt1", "my_tool"} <= {w[-1] for w in want}


def test_guarded_patterns_equal_plain_ones(spark):
    """strip, has_word and useful_lines run their patterns on some rows only; all rows come out as without that."""
    import random

    rng = random.Random(7)
    parts = [" ", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "a", "todo", "надо", "реализована", "реализовано_", "xtodo", "не работает", "done", "😀", "- ", "12. ", "long words here"]
    texts = [None, "", *parts, *["".join(rng.choices(parts, k=rng.randint(2, 9))) for _ in range(1500)]]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    x = F.col("x")
    ends = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    cut = F.transform(F.split(x, t.TERMINATORS), lambda l: ends(F.regexp_replace(l, r"(?U)^[\s\x1c-\x1f]*[-*\d.)]+[\s\x1c-\x1f]*", "")))
    pairs = [(t.strip(x), ends(x)), (t.useful_lines(x), F.filter(cut, lambda l: F.length(l).between(8, 500)))]
    pairs += [(t.has_word(x, w), x.rlike(rf"(?U)\b({w})\b")) for w in (t.COMPLETED, t.BUG, t.TODO, t.IDEA, t.DECISION, t.CONSTRAINT, t.QUESTION)]
    for a, b in pairs:
        assert df.where(~a.eqNullSafe(b)).select("x").collect() == []


def test_facts(spark):
    x = [item(i, *v, [i + 1], field="technologies") for i, v in enumerate([("SQLite", "active", "MEDIUM"), ("sqlite", "superseded", "HIGH"), ("SQLite", "active", "LOW")])]
    r = reconcile.merge_items(table(spark, *x)).first()
    assert (r["text"], r["status"], r["confidence"], r["blocks"], len(r["evidence"])) == ("SQLite", "superseded", "HIGH", [1, 2, 3], 3)
    old = [item(i, "Redis", blocks=[9, 3], field="technologies", is_old=True, id=str(i)) for i in range(3)]
    got = reconcile.merge_items(table(spark, *old, item(0, "redis", "disputed", blocks=[4], field="technologies"))).orderBy("pos").collect()
    assert [(r["id"], r["status"], r["blocks"], len(r["evidence"])) for r in got] == [("0", "active", [9, 3], 1), ("1", "active", [9, 3], 1), ("2", "disputed", [3, 4, 9], 2)]


def test_technology_changes(spark):
    tech = table(spark, item(0, "SQLite", field="technologies"))
    d = table(spark, item(5, "moved from SQLite to Postgres", blocks=[4]), item(6, "then from Postgres to MySQL"), item(7, "out", previous="MySQL"), item(8, "from Kafka to Redis", previous="redis"))
    done = {r["text"]: (r["status"], r["confidence"]) for r in reconcile.apply_changes(tech, reconcile.technology_changes(d)).collect()}
    assert done == {"SQLite": ("superseded", "MEDIUM"), "Postgres": ("superseded", "HIGH"), "MySQL": ("active", "HIGH"), "Redis": ("active", "HIGH")}


def test_sanitise_answers(spark):
    answer = {"summary": " s ", "technologies": [" Redis ", {"title": "Go", "confidence": "weird", "source_blocks": [1, "2", -1, True, 1, 2.9, "x"], "odd": 1}, 5, {"text": "  "}, {"text": "", "title": "T", "status": "Disputed"}],
              "decisions": ["plain", {"text": "t", "status": "superseded", "reason": 7}, 3], "tasks": [{"title": " x ", "status": "ODD"}, "no", {"text": "no title"}, {"title": "b", "status": "BUG"}],
              "agent_instructions": {"rules": ["r"], "commands": "no list", "other": ["x"]}}
    a = spark.createDataFrame([(1, "```json\n" + json.dumps(answer) + "\n```")], "id int, content string")
    assert document.answer_errors(a).count() == 0
    scalars, items = document.sanitise(a)
    assert tuple(scalars.first()) == (1, "s", "")
    got = [(r["field"], r["text"], r["status"], r["confidence"], r["blocks"], r["reason"]) for r in items.orderBy("field", "pos").collect()]
    assert got == [("decisions", "plain", None, "MEDIUM", [], ""), ("decisions", "t", None, "MEDIUM", [], "7"), ("rules", "r", None, None, [], None), ("tasks", "x", "todo", "MEDIUM", [], None), ("tasks", "b", "bug", "MEDIUM", [], None),
                   ("technologies", "Redis", None, None, [], None), ("technologies", "Go", None, "MEDIUM", [1, 2], None), ("technologies", "T", "disputed", "MEDIUM", [], None)]
    bad = spark.createDataFrame([(1, "[]"), (2, "{"), (3, '{"tasks":{}}'), (4, '{"agent_instructions":[]}'), (5, "{}")], "id int, content string")
    assert sorted((r["id"], r["error"]) for r in document.answer_errors(bad).collect()) == [(1, "no object"), (2, "no JSON"), (3, "tasks: no list"), (4, "agent_instructions: no object")]


def fact(text, **more):
    return {"id": hashlib.sha256(text.encode()).hexdigest()[:20], "text": text, "status": "active", "confidence": "HIGH", "source_blocks": [1], "evidence": [{"source": "s", "source_blocks": [1], "observed_at": "o"}]} | more


def stored(version=3, **more):
    doc = {k: [] for k in document.KEYS} | {k: "" for k in document.STRINGS} | {"schema_version": version, "project": "p", "display_name": "P", "agent_instructions": {k: [] for k in document.AGENT_FIELDS}}
    return doc | more


def as_files(spark, *docs):
    return spark.createDataFrame([(f"p{i}", d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "project string, content string")


def test_document_errors(spark):
    task = {"title": "t", **{k: v for k, v in fact("t").items() if k != "text"}}
    good = [stored(technologies=[fact("a"), fact("b")], todo_tasks=[task | {"status": "todo"}], decisions=[task | {"reason": "", "date": "", "previous": ""}], update_history=[{"date": "d", "source": "s", "mode": "create"}]), stored(2, technologies=["x", {"title": "y"}]), {"schema_version": 1, "project": "p"}]
    assert document.document_errors(as_files(spark, *good)).collect() == []
    bad = [("[]", "no object"), ("{", "no JSON"), (stored(4), "schema_version"), (stored(True), "schema_version"), (stored(0), "schema_version"), (stored(extra=1), "unknown extra"), ({k: v for k, v in stored().items() if k != "ideas"}, "missing ideas"), (stored(project=""), "project: empty"),
           (stored(summary=None), "summary: no text"), (stored(aliases=[1]), "aliases: no list of texts"), (stored(ideas={}), "ideas: no list"), (stored(agent_instructions={}), "agent_instructions: wrong keys"), (stored(update_history=[{"date": "d", "source": "s", "mode": "other"}]), "update_history: wrong event"),
           (stored(technologies=["plain"]), "text"), (stored(technologies=[fact("a", odd=1)]), "keys"), (stored(technologies=[fact("a", id="x")]), "id"), (stored(technologies=[fact("a"), fact("a")]), "unique_id"), (stored(technologies=[fact("a", confidence="SURE")]), "confidence"),
           (stored(technologies=[fact("a", source_blocks=[1, 1])]), "blocks"), (stored(technologies=[fact("a", source_blocks=[True])]), "blocks"), (stored(technologies=[fact("a", evidence=[{"source": ""}])]), "evidence"), (stored(technologies=[fact("a", status="todo")]), "status"),
           (stored(decisions=[task | {"reason": 1, "date": "", "previous": ""}]), "texts"), (stored(2, technologies=["same", "same"]), "unique_id"), ({k: v for k, v in stored(2).items() if k != "summary"}, "missing summary")]
    found = document.document_errors(as_files(spark, *[d for d, _ in bad])).collect()
    for i, (_, rule) in enumerate(bad):
        assert rule in {r["rule"] for r in found if r["project"] == f"p{i}"}, (i, rule)


def test_migrations(spark):
    v1 = {"schema_version": 1, "project": "my_tool", "update_history": [{"date": "", "source": "s", "mode": "create"}, {"date": "2020", "source": "s", "mode": "update"}], "last_updated": "2021", "technologies": [" Go ", {"title": "Rust", "confidence": "low", "source_blocks": [2], "status": "disputed"}], "todo_tasks": ["do", {"title": "d2", "status": "bug"}], "decisions": [{"title": "d", "date": "x"}], "agent_instructions": {"rules": ["r"]}}
    docs, items = document.read_documents(as_files(spark, v1, {"schema_version": 1, "project": "q", "last_updated": "2022"}))
    got = {r["project"]: r for r in docs.collect()}
    assert (got["p0"]["created_at"], got["p0"]["display_name"], got["p1"]["created_at"]) == ("2020", "My Tool", "2022")
    want = [("decisions", "d", "active", "MEDIUM", [], "x"), ("rules", "r", "active", "MEDIUM", [], ""), ("technologies", "Go", "active", "MEDIUM", [], ""), ("technologies", "Rust", "disputed", "LOW", [2], ""), ("todo_tasks", "do", "todo", "MEDIUM", [], ""), ("todo_tasks", "d2", "bug", "MEDIUM", [], "")]
    rows_ = items.orderBy("field", "pos").collect()
    assert [(r["field"], r["text"], r["status"], r["confidence"], r["blocks"], r["date"]) for r in rows_] == want and all(r["evidence"] == [] and len(r["id"]) == 20 for r in rows_)
    assert rows_[1]["id"] == hashlib.sha256(b"agent_instructions.rules\0r").hexdigest()[:20]
    assert document.document_errors(document.write_documents(docs, items)).collect() == []


def test_documents_are_read_once_an_item(spark):
    """No expression on a document's JSON is written out more than a few times in the plan: the parts of an item are taken once each."""
    files = spark.createDataFrame([("p", '{"schema_version":2,"ideas":[{"text":" a ","status":"idea"},{"title":"b","text":"c"},"d"],"technologies":["T",{"title":"u"},5]}')], "project string, content string")
    items = document.read_documents(files)[1].select("project", "field", "pos", "id", "text", "status", "confidence")
    assert sorted((r["field"], r["pos"], r["text"], r["status"]) for r in items.collect()) == [("ideas", 0, "a", "idea"), ("ideas", 1, "b", "idea"), ("ideas", 2, "d", "idea"), ("technologies", 0, "T", "active"), ("technologies", 1, "u", "active"), ("technologies", 2, "5", "active")]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count(f"$.{c}") for c in ("title", "text", "status", "confidence", "id")) <= 2


def test_documents_round_trip(spark):
    task = {"id": "0" * 20, "title": 'quote " and ё', "status": "bug", "confidence": "LOW", "source_blocks": [3], "evidence": []}
    doc = stored(summary='a "b"\n', aliases=["x"], technologies=[fact("b"), fact("a")], known_bugs=[task], decisions=[{"id": "1" * 20, "title": "t", "reason": "r", "date": "", "previous": "p", "status": "superseded", "confidence": "HIGH", "source_blocks": [], "evidence": []}], update_history=[{"date": "d", "source": "s", "mode": "create"}], created_at="c", last_updated="l")
    text = json.dumps(doc, ensure_ascii=False, indent=2) + "\n"
    back = document.write_documents(*document.read_documents(as_files(spark, text))).first()["content"]
    assert json.loads(back) == doc | {"project": "p0"} and list(json.loads(back)) == list(json.loads(text)) and "ё" in back and back.startswith("{\n  ")


HISTORY = """User: Working on river_mapper today with Python. We must not call the network: constraint number one.

Assistant: todo write the csv loader for river_mapper
bug: totals are broken in the map view

User: river_mapper again. We decided to move from SQLite to Postgres

Assistant: Which index is better for river_mapper, tree or hash?"""


def test_whole_run(spark, tmp_path):
    from lorekeep.plans import run

    root, told = f"file://{tmp_path}/s", []
    (tmp_path / "h.txt").write_text(HISTORY)
    go = lambda **k: run.run(spark, root, **{"history": f"{tmp_path}/h.txt", "observed_at": "2024-01-01T00:00:00+00:00", "say": told.append} | k)
    assert go().code == run.DONE
    store = Store(spark, root)
    files = store.files("river_mapper")
    assert sorted(files) == ["AGENTS.md", "DECISIONS.md", "PROJECT_CONTEXT.md", "TASKS.md", "memory.json"] and store.only_project() == "river_mapper"
    doc = json.loads(files["memory.json"])
    assert list(doc) == document.KEYS and [e["mode"] for e in doc["update_history"]] == ["create"] and {x["text"]: x["status"] for x in doc["technologies"]} == {"Python": "active", "SQLite": "superseded", "PostgreSQL": "active", "Postgres": "active"} and doc["created_at"] == "2024-01-01T00:00:00+00:00"
    assert [x["title"] for x in doc["todo_tasks"]] == ["todo write the csv loader for river_mapper"] and doc["known_bugs"] and doc["open_questions"] and doc["agent_instructions"]["do_not_change"] and "csv loader" in files["TASKS.md"]
    assert go().code == run.FAILED and "update" in told[-1] and store.files("river_mapper") == files  # what is there isn't overwritten
    (tmp_path / "h2.txt").write_text("User: river_mapper: write the csv loader completed and done\n\nAssistant: from Postgres to MySQL we decided for river_mapper")
    assert go(history=f"{tmp_path}/h2.txt", may_update=True, observed_at="2024-02-02T00:00:00+00:00").code == run.DONE
    new = json.loads(store.files("river_mapper")["memory.json"])
    assert [e["mode"] for e in new["update_history"]] == ["create", "update"] and new["created_at"] == doc["created_at"] and new["last_updated"].startswith("2024-02") and {x["text"]: x["status"] for x in new["technologies"]}["Postgres"] == "superseded"
    assert {x["id"] for x in new["technologies"]} > {x["id"] for x in doc["technologies"]}
    assert go(projects="Other Thing", choose=lambda found: "").code == run.NOTHING_CHOSEN and go(projects="...").code == run.FAILED and go(history=None).code == run.FAILED
    assert go(history=None, text="nothing to see here", may_update=True).stored == ["river_mapper"]  # the only stored project


def test_run_stores_the_others(spark, tmp_path, monkeypatch):
    from lorekeep.plans import run

    root = f"file://{tmp_path}/s"
    (tmp_path / "h.txt").write_text(HISTORY)
    commit = Store.commit

    def some(self, project, *a):
        if project == "bb_two":
            raise OSError("disk")
        return commit(self, project, *a)

    monkeypatch.setattr(Store, "commit", some)
    out = run.run(spark, root, f"{tmp_path}/h.txt", projects="aa_one, bb_two, cc_three")
    assert out.code == run.FAILED and sorted(out.stored) == ["aa_one", "cc_three"] and list(out.failed) == ["bb_two"]
    with pytest.raises(SystemExit):
        run.main(["--provider", "other"], spark)
    assert run.main(["--provider", "llm", str(tmp_path / "h.txt")], spark) == run.FAILED and run.main([], spark) == run.FAILED and run.main([str(tmp_path / "h.txt"), "--chunk-chars", "5"], spark) == run.FAILED
    assert run.main([str(tmp_path / "h.txt"), "--store", f"{root}2", "--yes"], spark) == run.DONE


def test_model_run(spark, tmp_path):
    from lorekeep.plans import run

    def client(system, user):
        if system.startswith("Find"):
            return json.dumps({"projects": [{"name": "River Mapper", "aliases": ["rm", " "], "message_numbers": ["1", 2, "x"], "confidence": "high"}, {"no": "name"}]})
        numbers = sorted({int(x) for x in re.findall(r'"number":(\d+)', user)})
        return json.dumps({"summary": f"S{numbers[0]}", "technologies": ["Go", {"text": "go", "source_blocks": numbers, "confidence": "HIGH"}], "tasks": [{"title": "one", "status": "idea"}]})

    (tmp_path / "h.txt").write_text("\n\n".join(f"User: river mapper {'words ' * 120}" for _ in range(6)))
    out = run.run(spark, f"file://{tmp_path}/s", f"{tmp_path}/h.txt", analyzer=run.Model(client, 1000))
    doc = json.loads(Store(spark, f"file://{tmp_path}/s").files("river_mapper")["memory.json"])
    assert out.code == run.DONE and doc["summary"] == "S6" and doc["aliases"] == ["rm"] and [(x["text"], x["source_blocks"], x["confidence"]) for x in doc["technologies"]] == [("go", [1, 2, 3, 4, 5, 6], "HIGH")] and [x["title"] for x in doc["ideas"]] == ["one"]
    assert run.run(spark, f"file://{tmp_path}/s2", f"{tmp_path}/h.txt", analyzer=run.Model(lambda s, u: "[]" if s.startswith("Coll") else client(s, u))).code == run.FAILED


def test_requests():
    from lorekeep.sources import model

    e = model.Endpoint("http://x", "m", retries=2)
    good = (200, {}, json.dumps({"choices": [{"message": {"content": "{}"}}]}).encode())
    waits = []

    def go(answers, end=e):
        left = list(answers)

        def send(*_):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        waits.clear()
        return model.complete(end, "s", "u", send=send, sleep=waits.append, jitter=lambda: 0)

    assert go([(503, {"Retry-After": "2"}, b""), good]) == "{}" and waits == [2.0]
    assert go([model.Unreachable("x"), model.Unreachable("x"), good]) == "{}" and waits == [1.0, 2.0]
    for answers in ([(400, {}, b"no")], [model.Unreachable("x")] * 3, [(503, {}, b"")] * 3, [(200, {}, b"x" * ((2 << 20) + 1))], [(200, {"Content-Length": str(3 << 20)}, b"")], [(200, {}, b"[]")], [(200, {}, b"{")]):
        with pytest.raises(RuntimeError):
            go(answers)
    assert model.wait_for(0, "Infinity", lambda: 1) == 1.25 and model.wait_for(9, None, lambda: 0) == 30 and model.wait_for(1, "-1", lambda: 0) == 2 and model.wait_for(0, "99") == 30
    for wrong in ({"url": "ftp://x"}, {"timeout": 0}, {"most_bytes": 0}, {"retries": 11}):
        with pytest.raises(ValueError):
            model.Endpoint(**{"url": "http://x", "model": "m"} | wrong)


def test_scalars(spark):
    pick = lambda a, b: spark.range(1).select(reconcile.choose_scalar(F.lit(a), F.lit(b))).first()[0]
    assert [pick("o", "n"), pick("o", ""), pick("o", "[NEEDS_REVIEW] n"), pick("", "[NEEDS_REVIEW] n")] == ["n", "o", "o", "[NEEDS_REVIEW] n"]
    with pytest.raises(ValueError):
        reduce.check_fan_in(1)


def test_render(spark):
    docs = spark.createDataFrame([("p", "P", "sum", "", "2024")], "project string, display_name string, summary string, purpose string, last_updated string")
    items = spark.createDataFrame([("p", "technologies", 0, "Redis", "superseded", "LOW", [1, 2])], "project string, field string, pos long, text string, status string, confidence string, blocks array<int>")
    dec = items.selectExpr("project", "pos", "text", "status", "confidence", "blocks", "'why' reason", "'' date", "'old' previous")
    r = document.render(docs, items, dec).first()
    assert "- Redis — status: superseded; confidence: LOW; источник: блоки 1, 2\n" in r["context"] and r["context"].startswith("# P\n\n## Краткое описание\n\nsum\n")
    assert "## Дата не указана — Redis\n\nПричина: why\nПредыдущее решение: old\nСтатус: заменено более поздним решением\n" in r["decisions"]
    assert document.NO_DATA in r["tasks"] and r["agents"].endswith(document.NO_DATA + "\n")


def test_store(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.files("p") is None and s.projects() == [] and s.only_project() is None and s.load("p") is None
    v1 = s.commit("p", {"a.md": "1"}, None)
    (tmp_path / "s/p/notes.txt").write_text("mine")
    v2 = s.commit("p", {"a.md": "ё"}, v1)
    assert s.files("p") == {"a.md": "ё"} and s.projects() == ["p"] and s.only_project() == "p"
    for based_on in (v1, None):
        with pytest.raises(Stale):
            s.commit("p", {"a.md": "3"}, based_on)
    for project, name in (("../x", "a"), ("p", "../a"), ("p", "a/b"), ("", "a")):
        with pytest.raises(ValueError):
            s.commit(project, {name: ""}, v2)
    assert s.files("p") == {"a.md": "ё"} and len(list((tmp_path / "s/p").glob("v-*"))) == 2
    (tmp_path / "s/p/v-left").mkdir()  # a crash before the pointer
    assert s.version("p") == v2
    (tmp_path / "s/p/P-000000000003").write_text("")  # a commit under way: readers see the old version, writers must wait
    assert s.version("p") == v2
    with pytest.raises(Stale):
        s.commit("p", {"a.md": "4"}, v2)
    s.recover("p")
    assert (tmp_path / "s/p/v-left").exists() and s.version("p") == v2  # it may live
    monkeypatch.setattr("lorekeep.sources.store.GRACE", -1.0)
    s.recover("p")
    assert s.version("p") == v2 and not (tmp_path / "s/p/v-left").exists() and not (tmp_path / f"s/p/{v1}").exists() and (tmp_path / "s/p/notes.txt").exists()
    v5 = s.commit("p", {"a.md": "5"}, v2)
    assert s.version("p") == v5 and s.files("p") == {"a.md": "5"}
    (tmp_path / "s/q").symlink_to(tmp_path)
    with pytest.raises(ValueError):
        s.commit("q", {"a.md": ""}, None)


def test_store_loads_what_it_can(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit("p", {"memory.json": json.dumps({"schema_version": 1, "project": "p", "last_updated": "2022", "technologies": ["Go"]})}, None)
    docs, items, v = s.load("p")
    assert docs.first()["created_at"] == "2022" and items.first()["text"] == "Go" and v == s.version("p") and json.loads(s.files("p")["memory.json"])["schema_version"] == 1
    for project, text in (("other", json.dumps({"schema_version": 1, "project": "p"})), ("broken", "{"), ("newer", json.dumps(stored(4, project="newer")))):
        s.commit(project, {"memory.json": text}, None)
        with pytest.raises(ValueError):
            s.load(project)
