"""The pipeline's stages, each on what the one before kept."""

import collections
import re

import corpus_pipeline as cp
import numpy as np
import pytest

from lorekeep.llm import jaccard, mixing, toxicity
from lorekeep.llm.common import cut

from ..conftest import SF
from .test_llm import empty, odd  # noqa: F401


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    assert [s for s, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "bpe"]
    for name, stage in cp.STAGES:
        out = cut(stage(spark, docs, SF), name)
        if name != "bpe":
            assert out.columns == docs.columns
        if name in ("toxicity", "simhash_near_dedup", "suffix_array_dedup"):
            assert 0.5 * n < out.count() <= docs.count()
        docs = out
    assert docs.where("n_tokens > 0").count() > 0


@pytest.mark.parametrize("labels", [[], [(1, 0, None), (4, 1, None)]])
def test_all_stay_without_labels(spark, odd, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_toxic_go_by_score(spark):
    """What stays is what one text at a time scores below the threshold, with the weights of the same fit."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    at, w, bias = toxicity.fit(toxicity.labelled_rows(docs, labels, modulus=None))
    weight = dict(zip(at.tolist(), w.tolist()))
    want = {r["doc_id"] for r in docs.collect() if toxicity.sigmoid(sum(weight.get(f, 0.0) for f in toxicity.features(r["text"]).tolist()) + bias) < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in cp.drop_toxic(spark, docs, SF).collect()} == want


def test_mix_takes_the_quotas(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    taken = {r["id"]: (r["taken"], r["first"]) for r in mixing.quotas(docs).collect()}
    got = collections.defaultdict(list)
    for r in cp.mix_sources(spark, docs, SF).collect():
        got[r["doc_id"]].append(words(r["text"]))
    for r in docs.collect():
        own, (n, first) = words(r["text"]), taken[r["doc_id"]]
        full, left = divmod(n, len(own)) if own else (0, 0)
        cut = [(own + own)[first : first + left]] if left else []
        assert sorted(got.get(r["doc_id"], []), key=repr) == sorted([own] * full + cut, key=repr), r["doc_id"]


def test_near_copies_go(spark):
    body = " ".join(f"word{i}" for i in range(300))
    rows = [(1, body), (2, body.replace("word100 ", "other ")), (3, body), (4, " ".join(f"else{i}" for i in range(200))), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == {1, 4, 5}


def kept_by_brute_force(rows):
    """Ids that stay: the least of each group linked at a Jaccard similarity of 0.8, all pairs compared."""
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    low = list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                low[max(p, q)] = min(p, q)
    return {rows[x][0] for x in range(len(rows)) if find(x) == x}


@pytest.mark.parametrize("kind", ["pairs", "crowd", "crowd in blocks"])
def test_near_copies_around_the_limit(spark, kind, monkeypatch):
    if kind == "crowd in blocks":
        monkeypatch.setattr(jaccard, "HOT", 16)
    rng = np.random.default_rng(6)
    rows = []
    if kind == "pairs":  # lone pairs of similarities from 0.7 to 0.9: one run of words replaced
        for k in range(150):
            words = [f"w{k}x{i}" for i in range(204)]
            n = int(rng.integers(7, 33))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:50] + [f"n{k}x{i}" for i in range(n)] + words[50 + n :]))]
    else:  # a crowd of copies of one text, each with its own words, similar to each other or not
        words = [f"w{i}" for i in range(204)]
        for k in range(150):
            at, n = int(rng.integers(0, 170)), int(rng.integers(4, 34))
            rows.append((k, " ".join(words[:at] + [f"n{k}x{i}" for i in range(n)] + words[at + n :])))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == kept_by_brute_force(rows)


def test_exact_check():
    a, b = ({bytes([i]) for i in range(lo, lo + 9)} for lo in (0, 1))
    assert jaccard.similar(a, b) and not jaccard.similar(a, {bytes([i]) for i in range(2, 11)}) and jaccard.similar(set(), set()) and not jaccard.similar(a, set())


def test_passages_go_and_clean_text_stays(spark):
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, f"own start of one. {shared} own end of one"), (2, f"two begins so; {shared}"), (3, "clean text " * 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in cp.cut_repeats(spark, docs, SF).collect()}
    assert "shared30" not in got[1]["text"] + got[2]["text"] and got[1]["text"].endswith("own end of one") and got[3]["text"] == rows[2][1] and got[1]["n_chars"] == len(got[1]["text"])


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_awkward_tables(spark, request, which):
    assert cp.run(spark, request.getfixturevalue(which)).count() >= 0
