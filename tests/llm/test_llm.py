"""The training-data operators against brute force, on real rows and on awkward ones."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import ann, bpe, hamming, langid, mixing, queries, simhash, suffix, tokencount, toolcalls, toxicity

from ..conftest import SF, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "long text without an end " * 3000
ODD = [
    (1, "A plain text, with words.", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, "A plain text, with words.", "en", "s1"), (4, "A plain text, with words.", "en", "s1"),
    (5, LONG, "fr", "s2"), (6, "12 !? 34", "de", None), (7, "日本語のテキスト " * 30 + "🙂", "ja", "s3"), (8, "x" * 3000, "en", "s1"), (None, "no id", None, "s2"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empties, repeats, long texts and clashing extra columns, as a folder of tables."""
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in ("id", "size", "row", "fp", "count", "n_tokens", "score", "g"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vec = [(i, [float(i % 7 - 3), 1.0, float(i % 3)], 0) for i in range(60)] + [(100, None, 0), (120, [0.0, 0.0, 0.0], 0), (140, [float("nan"), 1.0, 1.0], 0), (160, [1.0, 2.0], 0), (180, [], 0)]
    vec += [(i, [float((i * j) % 5 - 2) for j in range(1, 131)], 1) for i in range(200, 232)] + [(240, [1.0, None, 2.0], 0), (260, [None], 0)]
    rows = spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int")
    for c in ("id", "vec", "code", "block", "chunk", "score", "rank", "query_id", "distance", "n"):
        rows = rows.withColumn(c, F.lit("x"))
    rows.write.parquet(f"{d}/embeddings.parquet")
    conv = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a2"), (1, 2, "user", None), (2, 1, "assistant", "no call"), (None, 0, "user", "x"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    rows = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    for c in ("conv", "id", "level", "linked", "valid", "line", "content", "name", "arguments", "needs", "nth"):
        rows = rows.withColumn(c, F.lit("x"))
    rows.write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same(spark, name, queries.QUERIES[name], queries.SQL[name])


def texts(spark, d):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def bag(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("which", ["odd", SF])
def test_op1(spark, odd, which):
    d = odd if which == "odd" else which
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.codec(path, P.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(e := enc.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in texts(spark, d)]
    assert bag(map(tuple, queries.op1_bpe_round_trip(spark, d).collect())) == bag(want)


def test_op1_encode_decode(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert bag((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == bag((i, (t or "").encode()) for i, t in texts(spark, odd))


@pytest.mark.parametrize("word", ["a" * 700, "ab" * 100, "".join(np.random.default_rng(3).choice(list("etaoin"), 500))])
def test_op1_long_pieces(word):
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert c.contract([word.encode()])[0] == enc.encode_ordinary(word)


def test_op1_long_run_of_letters():
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    for word in ("".join(rng.choice(list("acgt"), 100_000)), "z" * 30_001, "abc" * 5000, "".join(rng.choice(list("ehlo wéß漢字".replace(" ", "")), 9000))):
        assert c.encode([word])[0].tolist() == enc.encode_ordinary(word)


def test_op1_whole_long_text(spark, monkeypatch):
    """One text of 32 MB, and slices much smaller than a text."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(path, P.PATTERN).ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    body = " ".join(t for _, t in texts(spark, SF) if t)
    for size, slice_ in ((32 << 20, None), (3 << 20, 1000)):
        if slice_:
            monkeypatch.setattr(bpe, "SLICE", slice_)
        text = (body * (size // len(body) + 1))[:size]
        ids = np.concatenate([i for i, _ in bpe.codec(path, P.PATTERN).slices(text)]) if slice_ else None
        want = enc.encode_ordinary(text)
        assert slice_ is None or ids.tolist() == want
        (got,) = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, P.PATTERN).collect()
        assert tuple(got) == (1, len(want), sha(",".join(map(str, want)).encode()), sha(text.encode()))


def test_op2_blocks_of_languages(spark, monkeypatch):
    rows = [(i, f"{'abcdefg'[i % 7] * 3} {'hijklmn'[i % 7] * 4} shared words here", f"l{i % 7}") for i in range(70)] + [(100, None, "l1"), (101, "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = bag(map(tuple, langid.predict(df, langid.fit(df)).collect()))
    monkeypatch.setattr(langid, "BLOCK_LANGS", 2)
    many = bag(map(tuple, langid.predict(df, langid.fit(df)).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in many] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(one, many)) and (101, langid.UND, 0.0) in many


def test_op2_equals_plain_cosines(spark):
    """Prediction by cosines in double precision, document by document."""
    rows = [(i, t, f"l{i % 3}") for i, t in enumerate(("one two three", "eins zwei drei", "un deux trois", "three words", "drei Worte", "trois mots"))]
    unit = lambda v: v / np.linalg.norm(v)
    docs = {i: unit(langid.bundles([t])[0].astype(float)) for i, t, _ in rows}
    protos = np.array([unit(sum(docs[i] for i, _, x in rows if x == f"l{k}")) for k in range(3)])
    protos = np.array([unit(p) for p in protos - protos.mean(axis=0) / 2])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in langid.predict(df, langid.fit(df)).collect():
        cos = protos @ docs[r["doc_id"]]
        assert r["lang_pred"] == f"l{cos.argmax()}" and abs(r["score"] - max(0, cos.max())) < 1e-4


def test_op2(spark, odd):
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, odd).collect()}
    assert all(got[i]["lang_pred"] == langid.UND and got[i]["score"] == 0 for i in (2, 3, 6)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    real = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert real.where("lang = lang_pred").count() / real.count() > 0.97


def test_op2_bundles_are_sums():
    a, b = "abc déf", "xyz"
    v = langid.bundles([a, b, None, "12"])
    one = sum(langid.gram_vector(tuple(ord(c) if c.isalpha() else 0 for c in g)).astype(float) for g in ("\0xy", "xyz", "yz\0", "z\0\0") if g[:2] != "\0\0" and g.count("\0") < 2)
    assert np.array_equal(v[1], one) and not v[2].any() and not v[3].any() and np.array_equal(v[0], langid.bundles([a])[0])


@pytest.mark.parametrize("which", ["odd", SF])
def test_op3(spark, odd, which):
    d = odd if which == "odd" else which
    tok = tokencount.tokenizer(P.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in texts(spark, d)]
    assert bag(map(tuple, queries.op3_token_counts(spark, d).collect())) == bag(want)


@pytest.mark.parametrize("text", ["x" * 900, "a b " * 300, " " * 500 + "end", "one<|endoftext|> two  three\n\n" * 50, "no-break" * 90 + " then words follow " * 20])
def test_op3_splices(text):
    tok = tokencount.tokenizer(P.path("byte_bpe_50k.json"))
    for size, overlap in ((100, 8), (257, 31)):
        assert tokencount.count_chunked(tok, text, size, overlap) == len(tok.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("which", ["odd", "/root/testdata/sf0.01"])
def test_op4(spark, odd, which):
    d = odd if which == "odd" else which
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    got = collections.defaultdict(list)
    for r in queries.op4_nearest_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    hits = total = 0
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:20]
            assert len(got[q]) == len(best) and got[q] == sorted(got[q])
            hits += len({i for _, i in best} & {i for _, i in got[q]})
            total += len(best)
    assert hits >= 0.9 * total


def test_op4_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21))


@pytest.mark.parametrize("which", ["odd", "/root/testdata/sf0.01"])
def test_op5(spark, odd, which):
    d = odd if which == "odd" else which
    docs = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sizes = collections.Counter()
    for _, n, s in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target = set(order), {}
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    got = mixing.quotas(spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert bag((r["id"], r["size"], r["source"]) for r in got) == bag(docs)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS * 2 for s in order)
    assert bag(map(tuple, got)) == bag(map(tuple, mixing.quotas(spark.read.parquet(f"{d}/documents.parquet")).collect()))


def test_op5_highest_quotients(spark):
    votes = np.random.default_rng(1).integers(0, 1000, 40).tolist()
    df = spark.createDataFrame([("g", k, v, 333) for k, v in enumerate(votes)], "g string, k int, v long, seats long")
    top = sorted(((-v / (2 * i - 1), k) for k, v in enumerate(votes) for i in range(1, 334) if v), key=lambda x: x)[:333]
    want = collections.Counter(k for _, k in top)
    assert {r["k"]: r["n"] for r in mixing.apportion(df, ["g"], "k", "v", "seats", "n").collect()} == {k: want[k] for k in range(40)}


def test_op5_apply_takes_those_words(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    want = mixing.quotas(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == want


def test_op6(spark, odd):
    same(spark, "op6", queries.op6_tool_calls, queries.SQL["op6_tool_calls"].replace("FROM conversations", f"FROM '{odd}/conversations.parquet/*.parquet'"), odd)
    calls = spark.createDataFrame([(1, 0, "a", "reply", '{"turn":1,"text":"x"}', ["b"]), (1, 1, "b", "reply", "[1]", []), (1, 2, "c", "other", "{}", ["d"]), (1, 3, "d", "reply", '{"turn":"1","text":"x"}', ["c"]), (1, 4, "e", "reply", '{"turn":1,"text":"x","more":1}', ["zz"])], "conv long, turn long, id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, 9, "a", "r")], "conv long, turn long, id string, content string")
    got = {r["id"]: (r["level"], r["linked"], r["valid"]) for r in toolcalls.link(calls, results, toolcalls.REPLY).collect()}
    assert got == {"a": (1, True, True), "b": (0, False, False), "c": (None, False, False), "d": (None, False, False), "e": (None, False, False)}


def test_op6_whole_chat(spark, tmp_path):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "tool", None), (1, 4, None, "c"), (None, 0, "system", "d"), (None, 1, "user", "e"), (2, None, "user", "f"), (None, 2, "assistant", "g"), (3, None, "assistant", "h")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sha = lambda line: hashlib.sha256(line.encode()).hexdigest()
    call = lambda turn, text, rest="": '{"arguments":"{\\"text\\":\\"%s\\"%s}",%s"name":"reply","role":"assistant"}' % (text, "" if turn is None else ',\\"turn\\":%d' % turn, rest)
    want = [
        (1, 0, None, None, False, False, sha('{"content":"be brief","role":"system"}')), (1, 1, "call_1_1", 0, True, True, sha(call(1, "a", '"content":"b","id":"call_1_1",'))),
        (1, 3, None, None, False, False, sha('{"role":"tool"}')), (1, 4, None, None, False, False, sha('{"content":"c"}')), (None, 0, None, None, False, False, sha('{"content":"d","role":"system"}')),
        (None, 1, None, None, False, True, sha(call(1, "e"))), (2, None, None, None, False, False, sha(call(None, "f"))),
        (None, 2, None, None, False, False, sha('{"content":"g","role":"tool"}')), (3, None, None, None, False, False, sha('{"content":"h","role":"tool"}')),
    ]
    assert bag(map(tuple, queries.op6_tool_calls(spark, str(tmp_path)).collect())) == bag(want)
    same(spark, "op6", queries.op6_tool_calls, queries.SQL["op6_tool_calls"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'"), tmp_path)


def test_op6_levels(spark):
    needs = {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(100)} | {"m": ["n7", "n50"], "after": ["m"], "mm": ["after", "n99"], "x": ["y"], "y": ["x"], "z": ["x", "n1"], "lost": ["none"]}
    rows = spark.createDataFrame([(1, k, v) for k, v in needs.items()], "conv long, id string, needs array<string>")
    got = {r["id"]: r["level"] for r in toolcalls.levels(rows).collect()}
    assert got == {f"n{i}": i for i in range(100)} | {"m": 51, "after": 52, "mm": 100}


def test_op6_levels_never_end_silently(spark):
    needs = {"a": [], "b": [], "c": ["a", "b"], "d": ["a", "c"], "e": ["c", "d"]}
    rows = spark.createDataFrame([(1, k, v) for k, v in needs.items()], "conv long, id string, needs array<string>")
    with pytest.raises(RuntimeError):
        toolcalls.levels(rows, max_rounds=2)
    assert {r["id"]: r["level"] for r in toolcalls.levels(rows, max_rounds=3).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 3}


def test_op6_canonical_arguments(spark):
    calls = [(1, k, f"c{k}", "reply", a, []) for k, a in enumerate(['{"turn":1,"text":"x"}', '{ "text" : "x",\n "turn": 1 }', "no json", None, '{"b":{"z":1,"a":[1,2]},"a":"é"}'])]
    results = spark.createDataFrame([], "conv long, turn long, id string, content string")
    got = {r["id"]: r["line"] for r in toolcalls.link(spark.createDataFrame(calls, "conv long, turn long, id string, name string, arguments string, needs array<string>"), results, toolcalls.REPLY).collect()}
    assert got["c0"].replace("c0", "") == got["c1"].replace("c1", "") and '"arguments":"no json"' in got["c2"] and "arguments" not in got["c3"]
    assert '{\\"a\\":\\"é\\",\\"b\\":{\\"a\\":[1,2],\\"z\\":1}}' in got["c4"]


def test_op7_odd_vectors(spark, odd):
    """Nulls in vectors, mixed lengths and over 64 components: brute force and the SQL agree."""
    got = bag(map(tuple, queries.op7_code_search(spark, odd).select("query_id", "rank", "vec_id", "distance").collect()))
    rows = [(r["vec_id"], [not c <= 0 for c in r["embedding"]]) for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect() if r["embedding"] and None not in r["embedding"]]
    want = []
    for q, a in rows:
        if q % 20 == 0:
            best = sorted((sum(x != y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b))[:10]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    assert got == bag(want) and any(q >= 200 for q, *_ in got)
    same(spark, "op7", queries.op7_code_search, queries.SQL["op7_code_search"].replace("FROM embeddings", f"FROM '{odd}/embeddings.parquet/*.parquet'"), odd)


def test_op7_hot_code(spark):
    df = spark.createDataFrame([(i, 5 if i < 300 else i) for i in range(340)] + [(999, None)], "vec_id long, code long")
    got = hamming.top_k(df, df.where("vec_id IN (0, 320)"), k=10).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 11))
    want = sorted((bin(320 ^ c).count("1"), i) for i, c in [(i, 5 if i < 300 else i) for i in range(340)] if i != 320)[:10]
    assert [(r["distance"], r["vec_id"]) for r in got if r["query_id"] == 320] == want


def test_op8_equals_plain_ftrl(spark):
    """The same sample learned one coordinate at a time with dictionaries."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["good", "bad", "day", "night", "word", "talk"], 6)), int(i % 3 == 0)) for i in range(60)]
    at, w, bias = toxicity.fit(spark.createDataFrame(rows, "id long, text string, y int"), epochs=2)
    order = {r["id"]: r["o"] for r in spark.createDataFrame(rows, "id long, text string, y int").select("id", toxicity.sample_order("id").alias("o")).collect()}
    z, n, bz, bn, l1 = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0, max(1.0, 0.15 * 60**0.5)
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    rate = lambda: -bz / ((toxicity.BETA + bn**0.5) / toxicity.ALPHA)
    for _ in range(2):
        for _, text, y in sorted(rows, key=lambda r: order[r[0]]):
            fs = toxicity.features(text).tolist()
            own = {f: weight(f) for f in fs}
            g = 1 / (1 + np.exp(-(sum(own.values()) + rate()))) - y
            for f in fs:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA * own[f]
                n[f] += g * g
            b = rate()
            bz, bn = bz + g - ((bn + g * g) ** 0.5 - bn**0.5) / toxicity.ALPHA * b, bn + g * g
    want = {f: v for f in list(z) if (v := weight(f))}
    assert set(at.tolist()) == set(want) and all(abs(want[f] - v) < 1e-5 for f, v in zip(at.tolist(), w.tolist())) and abs(bias - rate()) < 1e-9


def test_op8(spark, odd):
    got = queries.op8_toxicity(spark, odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    d = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    r = {(x["toxic"], x["predicted"]): x["count"] for x in queries.op8_toxicity(spark, d).where("held_out").join(y, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert r[1, 1] / (r[1, 1] + r.get((1, 0), 0)) > 0.7 and r.get((0, 1), 0) / (r[0, 0] + r.get((0, 1), 0)) < 0.01


def brute_components(fps, threshold):
    ids, f = list(fps), np.array(list(fps.values()), np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= threshold):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def brute_print(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9(spark):
    fps = {i: brute_print(t) for i, t in texts(spark, SF)}
    want = brute_components(fps, 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_op9_odd(spark, odd):
    got = {r["doc_id"]: r for r in queries.op9_simhash(spark, odd).collect()}
    assert got[2]["fingerprint"] == "0" * 16 and got[3]["component_id"] == 2 and got[4]["component_id"] == 1 and len(got) == 9


def test_op9_keys():
    """Of fingerprints within the threshold, some key differs in at most one bit; keys grow with the number of fingerprints."""
    rng = np.random.default_rng(9)
    for threshold, words in ((4, 1), (3, 1), (6, 2)):
        for j in range(1, 6):
            found = simhash.keys(words, threshold, j)
            for _ in range(500 if found else 0):
                flipped = set(rng.choice(64 * words, threshold, replace=False).tolist())
                assert min(sum(64 * w + b <= x < 64 * w + b + n for x in flipped for w, b, n in k) for k in found) <= 1
    assert [len(simhash.keys_for(n, 1, 4)) for n in (0, 10**6, 10**9, 10**11)] == [3, 3, 10, 20]
    with pytest.raises(ValueError):
        simhash.keys_for(1, 1, 60)


@pytest.mark.parametrize("j, crowd", [(1, None), (2, None), (3, None), (1, 50), (2, 20)])
def test_op9_dense_and_chained(spark, j, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "keys_for", lambda n, words, threshold: simhash.keys(words, threshold, j))
    if crowd:  # anchors in blocks
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "THIN", 1)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40).tolist()
    fps = {}
    for b in base:
        x = b
        for _ in range(12):  # a chain, each some bits from the one before
            fps[len(fps)] = x
            for bit in rng.choice(64, 4, replace=False):
                x ^= 1 << int(bit)
    for k in range(300):  # one dense group
        fps[len(fps)] = base[0] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
    signed = lambda v: int(np.uint64(v).astype(np.int64))
    prints = spark.createDataFrame([(i, [signed(v)]) for i, v in fps.items()], "id long, fp array<long>")
    if crowd:
        found = simhash.keys(1, 4, j)
        blocks = simhash.crowded(prints, found, max(sum(w for _, _, w in k) for k in found)).agg(F.min("blocks"), F.max("blocks")).first()
        assert 3 <= blocks[0] < blocks[1]
    got = prints.join(simhash.classes(prints, 1, 4), "fp")
    assert {r["id"]: r["component"] for r in got.collect()} == brute_components(fps, 4)


def test_op9_wide_and_null_ids(spark):
    big = 2**60 + 1
    rows = [(big, [0]), (big + 2, [1]), (big + 4, [2**40]), (None, [3]), (7, [-1]), (None, [-2]), (None, [0x0F0F0F0F0F0F0F0F]), (None, [0x0F0F0F0F0F0F0F0E])]
    prints = spark.createDataFrame(rows, "id long, fp array<long>")
    got = {r["fp"][0]: r["component"] for r in simhash.classes(prints, 1, 4).collect()}
    assert {got[f] for f in (0, 1, 2**40, 3)} == {big} and got[-1] == got[-2] == 7
    assert got[0x0F0F0F0F0F0F0F0F] == got[0x0F0F0F0F0F0F0F0E] is not None


def test_op9_one_fingerprint_for_a_third(spark):
    rows = [(i, [0]) for i in range(300)] + [(1000 + i, [int(x)]) for i, x in enumerate(np.random.default_rng(1).integers(0, 2**62, 600))]
    prints = spark.createDataFrame(rows, "id long, fp array<long>")
    got = {r["id"]: r["component"] for r in prints.join(simhash.classes(prints, 1, 4), "fp").collect()}
    assert len(got) == 900 and {got[i] for i in range(300)} == {0}


@pytest.mark.parametrize("which", ["odd", SF, "repeats", "segments"])
def test_op10(spark, odd, which, monkeypatch, tmp_path):
    d = odd if which == "odd" else which
    if which == "segments":
        monkeypatch.setattr(suffix, "UNIT", 700)
        d = SF
    if which == "repeats":
        rng = np.random.default_rng(5)
        piece = lambda n: "".join(rng.choice(list("abcdefgh "), n))
        a, b = piece(199), piece(260)
        rows = [(1, a + piece(50)), (2, piece(30) + a), (3, piece(10) + b + piece(400) + b), (4, "z" * 500), (5, b[5:205]), (6, b[:-1] + "#" + piece(20)), (7, "ab" * 90), (8, b + b)]
        d = str(tmp_path)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        monkeypatch.setattr(suffix, "GROUP", 2)
    raw = [(i, (t or "").encode()) for i, t in texts(spark, d)]
    seen = collections.Counter(t[k : k + 200] for _, t in raw for k in range(len(t) - 199))
    want = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.append((i, len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert bag(map(tuple, queries.op10_suffix_dedup(spark, d).collect())) == bag(want)
