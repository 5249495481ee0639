"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least SIMILAR, each link checked exactly.

SimHash finds the nearest copies: op9's fingerprints and anchors, at SIMHASH_BITS or fewer differing bits. It can't find
pairs of similarity 0.8 at a bearable cost (see the README), so MinHash adds the rest: of BANDS * ROWS permutations of
the shingles' hashes, each band of ROWS minima is a key. A pair of similarity s shares no key with chance
(1 - s ** ROWS) ** BANDS: 5e-5 at 0.8, less above. Two bits of each minimum make a sketch; pairs that share a key are
candidates up to FAR differing bits, five standard deviations over the mean at 0.8, so that the sketch loses about one
pair in a million. No list of a key's rows is capped.

Two texts are linked only if their shingle sets, compared as bytes, have that similarity. A group of n copies is not
listed pair by pair:

  1. SimHash's links, and for each text one near partner by MinHash, found by growth at each key, are checked. What
     they link is a part.
  2. Texts that share a key with a candidate of another part are marked, one row for each text and key.
  3. These go to their keys with the hashes of their shingles. At a key, a part grows by comparing its texts with those
     of other parts, and what joins it is compared no more; a pair that meets at several keys is compared at the first
     only. The links found, fewer than the texts at the key, are checked.

A key of over HOT rows is compared in blocks, each pair of blocks in a group of its own, so no group grows with the data.

Texts of equal shingle sets are one node. Null and empty texts and texts without words are one node; texts with fewer
words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components
from .simhash import _WORD, _grow

BANDS, ROWS, SKETCH = 25, 5, 4
#: Shared shingles of all shingles, as a fraction.
SIMILAR = (4, 5)
#: Differing bits of a sketch: a similarity of about 0.8 in the mean, and five standard deviations over that.
NEAR, FAR = 25, 54
SIMHASH_BITS = 4
#: Rows of a key that are compared at once.
HOT = 16_384
_RNG = np.random.default_rng(42)
_XOR, _ODD = _RNG.integers(0, 2**64, (2, 32 * SKETCH, 1), np.uint64)
_ODD |= np.uint64(1)
_MIX = _RNG.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)
_BITS = [f"f{i}" for i in range(SKETCH)]


def shingles(text: str | None, n: int) -> set[bytes]:
    """The n-word shingles, ASCII letters in lower case."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def hashes(text: str | None, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of the shingles."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)], np.uint64))


def enough(shared, a, b):
    """shared of two sets' a and b shingles are as many as the similarity asks for."""
    return shared * SIMILAR[1] >= (a + b - shared) * SIMILAR[0]


def similar(a: set[bytes], b: set[bytes]) -> bool:
    return a == b or enough(len(a & b), len(a), len(b))


def signature(text: str | None, n: int) -> tuple[list[int], int, list[int], list[int]]:
    """(128 bits that tell shingle sets apart, SimHash's fingerprint of the set, the keys, the sketch), as longs."""
    import xxhash

    h = hashes(text, n)
    whole = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
    least = np.full(32 * SKETCH, 2**64 - 1, np.uint64)
    for lo in range(0, len(h), 4096):
        least = np.minimum(least, ((h[lo : lo + 4096] ^ _XOR) * _ODD).min(axis=1))
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = (key ^ (key >> np.uint64(29)) ^ least[r : BANDS * ROWS : ROWS]) * _MIX[r]
    bits = (least.reshape(SKETCH, 32) & np.uint64(3)) << np.arange(0, 64, 2, dtype=np.uint64)
    fp = simhash.majority(simhash.bit_counts(h), len(h))
    return whole.tolist(), int(np.uint64(fp).view(np.int64)), (key ^ (key >> np.uint64(32))).view(np.int64).tolist(), np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


def signatures(text: Column, n: int) -> Column:
    """struct<whole array<long>, fp long, keys array<long>, sketch array<long>>."""

    @F.pandas_udf("whole array<long>, fp long, keys array<long>, sketch array<long>")
    def own(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.begin("jaccard")
        for s in texts:
            yield pd.DataFrame([signature(t, n) for t in s], columns=["whole", "fp", "keys", "sketch"])
        common.give_back()

    return own(text)


def _at_keys(nodes: DataFrame, *more: str) -> DataFrame:
    """A row for each node and key: (key, band, node, more columns, the sketch's longs)."""
    spread = nodes.select("node", *more, *[F.element_at("sketch", i + 1).alias(c) for i, c in enumerate(_BITS)], F.posexplode("keys").alias("band", "key"))
    return spread.withColumn("key", F.col("key").bitwiseXOR(F.col("band").cast("long")))


def _sketches(b: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(b[_BITS].to_numpy(np.int64)).view(np.uint64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def near_links(nodes: DataFrame) -> DataFrame:
    """nodes: (node, keys, sketch). (a, b, d), a < b: pairs that share a key and differ in d <= NEAR bits, so many that they span most of the groups of each key; and (key, null, rows) for keys of over HOT rows, at least once."""
    hot = HOT

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("jaccard")

        def run(b: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
            key, node, sketch = b["key"].to_numpy(), b["node"].to_numpy(np.int64), _sketches(b)
            starts, sizes = _groups(key)
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            small = np.repeat(np.where(sizes <= 8, sizes, 0), sizes)
            place = np.arange(len(b)) - np.repeat(starts, sizes)
            for step in range(1, 8):
                at = np.flatnonzero(place + step < small)
                x.append(at), y.append(at + step)
            x, y = np.concatenate(x), np.concatenate(y)
            d = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1).astype(np.int64)
            grown = [(p, q) for s, n in zip(starts[sizes > 8], sizes[sizes > 8]) for p, q in _grow(sketch[s : s + n], np.ones(n, bool), np.arange(s, s + n), NEAR)]
            p, q = np.array(grown, np.int64).reshape(-1, 2).T
            x, y, d = np.concatenate([x[d <= NEAR], p]), np.concatenate([y[d <= NEAR], q]), np.concatenate([d[d <= NEAR], np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1).astype(np.int64)])
            first = np.ones(len(b), bool)
            first[y] = False  # of each group, the text from which it grew
            return pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": pd.array(np.maximum(node[x], node[y]), "Int64"), "d": d}), first

        rest, count, of = None, 0, None
        for b in batches:
            if len(b):
                b = b if rest is None else pd.concat([rest, b], ignore_index=True)
                count -= 0 if rest is None else len(rest)
                last = b["key"].iloc[-1]
                goes_on = (b["key"] == last).to_numpy()
                if not goes_on.all():
                    yield run(b[~goes_on])[0]
                rest = b[goes_on].reset_index(drop=True)
                count, of = (count if last == of else 0) + len(rest), last
                if len(rest) > hot:  # a key of any size is compared with the first texts of the groups that it has so far
                    found, first = run(rest)
                    rest = rest[first]
                    yield pd.concat([found, pd.DataFrame({"a": [last], "b": pd.array([None], "Int64"), "d": [count]})])
        if rest is not None:
            yield run(rest)[0]
        common.give_back()

    return _at_keys(nodes).drop("band").repartition("key").sortWithinPartitions("key", "node").mapInPandas(compare, "a long, b long, d long")


def _in_blocks(rows: DataFrame, hot_keys: DataFrame | None) -> DataFrame:
    """Adds pair: rows of a key in hot_keys (key, rows) come once for each pair of blocks that their block is in."""
    if hot_keys is None:
        return rows.withColumn("pair", F.lit(0).cast("long"))
    x = rows.join(hot_keys, "key", "left").withColumn("_blocks", F.ceil(F.coalesce("rows", F.lit(1)) / HOT).cast("long"))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("_blocks"))
    x = x.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return x.withColumn("pair", F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other")).drop("rows", "_blocks", "_own", "_other")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined and cut so that the rows of a (key, pair) come together."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if len(b):
            held.append(b)
            key, pair = b["key"].iloc[-1], b["pair"].iloc[-1]
            if held[0]["key"].iloc[0] != key or held[0]["pair"].iloc[0] != pair:
                rows = pd.concat(held, ignore_index=True)
                done = ((rows["key"] != key) | (rows["pair"] != pair)).to_numpy()
                yield rows[done].reset_index(drop=True)
                held = [rows[~done].reset_index(drop=True)]
    if held:
        yield pd.concat(held, ignore_index=True)


def meeting(nodes: DataFrame, hot_keys: DataFrame | None) -> DataFrame:
    """nodes: (node, part, keys, sketch). (key, pair, band, node, part, sketch's longs) of nodes that meet a candidate of another part at the key."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("jaccard")
        for b in _whole(batches):
            part, sketch = b["part"].to_numpy(np.int64), _sketches(b)
            starts, sizes = _groups(b["key"].to_numpy(), b["pair"].to_numpy())
            met = np.zeros(len(b), bool)
            small = np.repeat(np.where(sizes <= 8, sizes, 0), sizes)
            place = np.arange(len(b)) - np.repeat(starts, sizes)
            for step in range(1, 8):
                x = np.flatnonzero(place + step < small)
                x = x[part[x] != part[x + step]]
                x = x[np.bitwise_count(sketch[x] ^ sketch[x + step]).sum(axis=1) <= FAR]
                met[x] = met[x + step] = True
            for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
                at = np.arange(s, s + n)
                kinds, counts = np.unique(part[at], return_counts=True)
                # every pair of two parts has a row that isn't of the largest
                for x in at[part[at] != kinds[counts.argmax()]]:
                    hit = at[(part[at] != part[x]) & (np.bitwise_count(sketch[at] ^ sketch[x]).sum(axis=1) <= FAR)]
                    met[hit] = True
                    met[x] |= len(hit) > 0
            yield b[met]
        common.give_back()

    rows = _in_blocks(_at_keys(nodes, "part"), hot_keys)
    return _together(rows.select("key", "pair", "band", "node", "part", *_BITS)).mapInPandas(mark, "key long, pair long, band int, node long, part long, " + ", ".join(f"{c} long" for c in _BITS))


def _links_of(part: np.ndarray, sketch: np.ndarray, keys: np.ndarray, band: int, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of similar texts of different parts, so many that they span all groups of the parts."""
    size, out, left = np.array([len(s) for s in sets]), [], np.arange(len(part))
    while len(left) > 1:
        own = part[left] == part[left[0]]
        queue, left = left[own].tolist(), left[~own]
        while queue and len(left):
            x = queue.pop()
            some = left[np.bitwise_count(sketch[left] ^ sketch[x]).sum(axis=1) <= FAR]
            some = some[enough(np.minimum(size[some], size[x]), size[some], size[x])]
            some = some[~(keys[some, :band] == keys[x, :band]).any(axis=1)]
            if not len(some):
                continue
            flat = np.concatenate([sets[y] for y in some])
            at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
            shared = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
            for y in some[enough(shared, size[some], size[x])]:
                joins = part[left] == part[y]
                if joins.any():
                    out.append((x, int(y)))
                    queue += left[joins].tolist()
                    left = left[~joins]
    return out


def links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """met: from meeting(); sets: (node, keys, hashes binary). (a, b, part_a, part_b): similar texts that join parts."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("jaccard")
        low: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := low.setdefault(x, x)) != x:
                low[x] = low[up]
                x = up
            return x

        for b in _whole(batches):
            part, node, sketch = b["part"].to_numpy(np.int64), b["node"].to_numpy(np.int64), _sketches(b)
            keys, band = np.stack(b["keys"].to_numpy()), b["band"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in b["hashes"]]
            out = []
            for s, n in zip(*_groups(b["key"].to_numpy(), b["pair"].to_numpy())):
                for x, y in _links_of(part[s : s + n], sketch[s : s + n], keys[s : s + n], int(band[s]), sets[s : s + n]):
                    p, q = find(int(part[s + x])), find(int(part[s + y]))
                    if p != q:  # else this task has joined the two by other links
                        low[p] = q
                        out.append((node[s + x], node[s + y], part[s + x], part[s + y]))
            if len(low) > simhash.LINKED_NODES:
                low.clear()
            yield pd.DataFrame(out, columns=["a", "b", "part_a", "part_b"]).astype("int64")
        common.give_back()

    return common.small_batches(_together(met.join(sets, "node")), 512).mapInPandas(join, "a long, b long, part_a long, part_b long")


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    involved = common.cut(nodes.distinct(), "involved")
    out = common.cut(texts.join(involved, "node", "left_semi"), "involved_texts")
    common.discard(involved)
    return out


def checked(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs: (a, b, other columns), written; texts: (node, text). Those pairs whose texts are similar."""

    @F.pandas_udf("boolean")
    def ok(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        common.begin("jaccard")
        for a, b in batches:
            out, last, of_last = [], None, set()
            for x, y in zip(a, b):
                if x is not last and x != last:
                    last, of_last = x, shingles(x, n)
                out.append(similar(of_last, shingles(y, n)))
            yield pd.Series(out, dtype=bool)
        common.give_back()

    some = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts)
    left, right = some.select(F.col("node").alias("a"), F.col("text").alias("_left")), some.select(F.col("node").alias("b"), F.col("text").alias("_right"))
    out = common.cut(pairs.join(left, "a").join(right, "b").where(ok("_left", "_right")).select(*pairs.columns), "checked")
    common.discard(some)
    return out


def groups(nodes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """nodes: (node, fp, keys, sketch), one for each shingle set; texts: (node, text) of these at least. (node, component) of linked nodes."""
    near = common.cut(near_links(nodes.select("node", "keys", "sketch")), "near")
    # each node with one partner before it: a surely similar one if there is one, of these the least
    first = near.where("b IS NOT NULL").groupBy("b").agg(F.min(F.struct((F.col("d") > NEAR * 2 // 3).alias("far"), "a")).alias("to")).select("to.a", "b")
    copies = simhash.links(nodes.select("node", F.array("fp").alias("fp")), 1, SIMHASH_BITS)
    pairs = common.cut(first.unionByName(copies).distinct(), "pairs")
    linked = checked(pairs, texts, n)
    parts = components(linked).withColumnRenamed("component", "part")
    placed = common.cut(nodes.select("node", "keys", "sketch").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
    hot = common.cut(near.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.max("d").alias("rows")), "hot")
    met = common.cut(meeting(placed, hot if hot.limit(1).count() else None), "met")
    common.discard(near, pairs, linked, hot)

    @F.pandas_udf("binary")
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series([hashes(t, n).tobytes() for t in text])

    some = _texts_of(met.select("node"), texts)
    sets = common.cut(some.select("node", hashed("text").alias("hashes")).join(placed.select("node", "keys"), "node"), "sets")
    found = common.cut(links(met, sets), "found")
    common.discard(some, sets, met)
    joins = checked(found, texts, n)
    over = components(joins.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).select(F.col("node").alias("part"), "component")
    out = placed.select("node", "part").join(over, "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    return out
