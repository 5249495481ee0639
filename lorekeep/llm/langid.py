"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector of DIM components, seeded by its code point. The vector of a letter n-gram
binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a document bundles (adds) the vectors
of its n-grams; a prototype bundles the unit vectors of a language's documents. A document gets the language whose
prototype has the largest cosine with it.

The bundle of a unit of texts is one matrix product: n-gram counts of the documents times the n-grams' vectors, taken
in blocks of BLOCK n-grams, so memory doesn't grow with the alphabet.

Lower-casing is Unicode's; a run of other characters than letters is one blank, and a blank binds like a letter.
Defined results: a null text, or one without letters, is `und` with score 0; ties go to the language first in code
point order; with no labelled row every text is `und`. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1024
N = 3
BLOCK = 4096
#: Characters of text that are counted as one matrix product.
UNIT = 1 << 20
#: Languages whose prototypes, DIM doubles each, go to the driver and to every task at a time.
BLOCK_LANGS = 2000
UND = "und"


@lru_cache(maxsize=20_000)
def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    return np.random.default_rng([code, 7]).integers(0, 2, dim, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=60_000)
def gram_vector(gram: tuple[int, ...], dim: int = DIM) -> np.ndarray:
    """Letters' vectors, the first rotated most, bound by multiplication."""
    out = np.ones(dim, np.int8)
    for place, code in enumerate(gram):
        out = out * np.roll(letter_vector(code, dim), len(gram) - 1 - place)
    return out


def bundles(texts: list[str | None], n: int = N, dim: int = DIM) -> np.ndarray:
    """One row of dim for each text: the sum of its n-grams' vectors; zeros if it has no letter."""
    out = np.zeros((len(texts), dim), np.float32)
    joined = ["\0" + (t.lower() if t else "") + "\0" * n for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in joined])
    alphabet, at = np.unique(codes, return_inverse=True) if len(codes) else (codes, codes)
    is_letter = np.array([chr(c).isalpha() for c in alphabet] or [False])
    kind = np.where(is_letter[at], at + 1, 0) if len(codes) else at  # 0: blank
    kept = np.ones(len(kind), bool)
    kept[1:] = (kind[1:] != 0) | (kind[:-1] != 0) | (doc[1:] != doc[:-1])  # a run of blanks is one
    kind, doc = kind[kept].astype(np.int64), doc[kept]
    if len(kind) < n:
        return out
    key, base = np.zeros(len(kind) - n + 1, np.int64), len(alphabet) + 1
    for i in range(n):
        key = key * base + kind[i : len(kind) - n + 1 + i]
    first, last = doc[: len(key)], doc[n - 1 :]
    some = np.zeros(len(key), bool)
    for i in range(n):
        some |= kind[i : len(key) + i] != 0
    use = (first == last) & some
    key, first = key[use], first[use]
    if base**n <= 1 << 22:
        seen = np.zeros(base**n, bool)
        seen[key] = True
        grams = np.flatnonzero(seen)
        lut = np.zeros(base**n, np.int32)
        lut[grams] = np.arange(len(grams))
        gram = lut[key]
    else:
        grams, gram = np.unique(key, return_inverse=True)
    for lo in range(0, len(grams), BLOCK):
        own = grams[lo : lo + BLOCK]
        mine = slice(None) if len(grams) <= BLOCK else (gram >= lo) & (gram < lo + BLOCK)
        counts = np.bincount(first[mine].astype(np.int64) * len(own) + (gram[mine] - lo), minlength=len(texts) * len(own))
        vectors = np.empty((len(own), dim), np.float32)
        for row, g in enumerate(own.tolist()):
            places = []
            for _ in range(n):
                g, k = divmod(g, base)
                places.append(int(alphabet[k - 1]) if k else 0)
            vectors[row] = gram_vector(tuple(reversed(places)), dim)
        out += counts.reshape(len(texts), len(own)).astype(np.float32) @ vectors
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", n: int = N, dim: int = DIM) -> DataFrame:
    """Prototypes (lang, block, parts array<double>), from all rows with a language and letters, BLOCK_LANGS languages a block, written to the shared folder.

    Each task sends one partial bundle for each language that it has read, BLOCK_LANGS at a time.
    """

    def sums_of(total: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"lang": pd.Series(list(total), dtype=object), "part": pd.Series(list(total.values()), dtype=object)})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b["text"].tolist(), b["lang"].to_numpy(object)
            for lo, hi in common.units(texts, UNIT):
                v = _unit(bundles(texts[lo:hi], n, dim)).astype(np.float64)
                for lang in dict.fromkeys(langs[lo:hi]):
                    total[lang] = total.get(lang, 0) + v[langs[lo:hi] == lang].sum(axis=0)
                if len(total) > BLOCK_LANGS:
                    yield sums_of(total)
                    total = {}
        yield sums_of(total)

    src = common.small_batches(df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL"))
    sums = (
        src.mapInPandas(partial, "lang string, part array<double>")
        .select("lang", F.posexplode("part").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum(F.round("x", 6).cast("decimal(30,6)")).cast("double").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("parts"))
    )  # sums of decimals don't depend on the order of tasks
    sums = common.cut(sums.select("lang", F.transform("parts", lambda p: p["x"]).alias("parts")).where(F.exists("parts", lambda x: x != 0)), "prototypes")
    blocks = int(np.ceil(sums.count() / BLOCK_LANGS))
    return sums.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks))).cast("int")) if blocks > 1 else sums.withColumn("block", F.lit(0))


def predict(df: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), n: int = N, dim: int = DIM) -> DataFrame:
    """(id, the columns of keep, lang_pred, score), by the prototypes of fit().

    Half of the languages' mean is taken off every prototype, as what all share doesn't tell them apart; score is the
    cosine with what is left, 0 if negative. Blocks of languages come one after the other, and the best so far stays.
    """
    def block(k: int) -> tuple[list[str], np.ndarray]:
        rows = sorted((r["lang"], r["parts"]) for r in model.where(F.col("block") == k).select("lang", "parts").collect())  # about BLOCK_LANGS
        return [r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64).reshape(-1, dim))

    numbers = sorted(r[0] for r in model.select("block").distinct().collect())
    total, count = np.zeros(dim), 0
    for k in numbers if len(numbers) > 1 else []:
        _, protos = block(k)
        total, count = total + protos.sum(axis=0), count + len(protos)

    def best_of(src: DataFrame, k: int) -> DataFrame:
        langs, protos = block(k)
        n_langs, mean = (count, total / count) if count else (len(langs), protos.mean(axis=0) if len(langs) else 0)
        protos = (_unit(protos - mean * 0.5) if n_langs > 1 else protos).astype(np.float32)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts = b["text"].tolist()
                for lo, hi in common.units(texts, UNIT):
                    out = b.iloc[lo:hi]
                    v = bundles(texts[lo:hi], n, dim)
                    some = v.any(axis=1)
                    cos = _unit(v) @ protos.T
                    best = cos.argmax(axis=1)
                    pred, score = np.array(langs, object)[best], np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
                    was, before = out["lang_pred"].to_numpy(object), out["score"].to_numpy()
                    wins = some & ((was == UND) | (score > before) | ((score == before) & np.array([p < w for p, w in zip(pred, was)], bool)))
                    yield out.assign(lang_pred=np.where(wins, pred, was), score=np.where(wins, score, before))

        return src.mapInPandas(work, src.schema)

    src = common.small_batches(df.select(F.col(id_col).alias(id_col), *keep, F.col(text_col).alias("text"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score")))
    for k in numbers:
        src = best_of(src, k)
    return src.drop("text")
