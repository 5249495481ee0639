"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit for each bit of its shingles' hashes: 1 if set in over half of them. Fingerprints
are linked at `threshold` or fewer differing bits. They are cut into p parts, and every j of these make a key. Two
fingerprints within the threshold differ in at most t = 1 bit of some key: with j = 1 and p over threshold / 2, as two
bits in each part would be too many; with j > 1 and p = threshold + j - 1, as a key of the j parts that differ least
could have two bits only if all other parts had one each, threshold + 1 in all. So every link is found, whatever j.
The anchors of a key are the code words of a covering code: the perfect Hamming [15, 11] code on the lowest 15 bits,
of covering radius R = 1, times all values of the other bits. A fingerprint lives at the one anchor within R of it and
is replicated to all anchors within R + t: any fingerprint within t of it lives at one of these. So fingerprints are
compared only where one visits the anchor at which the other lives.

At threshold 4, j = 1 gives 3 keys of 21 bits and 42 rows a fingerprint, j = 2 gives 10 of 24 bits, j = 3 20 of 30.
j is the least for which not over LIVING fingerprints live at an anchor in the mean, so anchors grow with the data and
an anchor does not.

Fingerprints may differ and yet crowd at an anchor. Where keys that over THIN fingerprints share bring more than CROWD to
an anchor, its rows go into blocks by the hash of the node, and each two blocks meet in a task of their own: all pairs
of rows still share one, so no link is lost, and no task holds more than two blocks.

Documents of equal fingerprint are one node from the start. At an anchor, links are found by breadth-first growth:
each fingerprint is compared with those of the anchor that no group has yet, so a group of n fingerprints makes n - 1
links and no list of all its pairs. Components are then joined over anchors.

Null and empty texts and texts without words have fingerprint zero. Texts with fewer words than a shingle are one
shingle. Repeated rows count each. Rows with a null id have a component by their fingerprint like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints that live at an anchor, in the mean; more make keys longer.
LIVING = 4096
#: Rows at an anchor beyond which it is cut into blocks of half as many; keys of up to THIN fingerprints aren't counted
#: there: only some hundreds of keys come to one anchor.
CROWD, THIN = 131_072, 256
#: Fingerprints whose keys a task makes, where there are so many.
SPREAD_NODES = 65_536
#: Bits of a key: the code's at least, and what a long has room for beside the key's number.
SHORTEST, LONGEST = 15, 46
#: A task joins the links of its anchors and gives each linked node's to the least of its group; it holds about so many nodes.
LINKED_NODES = 200_000


def _scramble(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is 1, the highest bit first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, k: int) -> int:
    """The fingerprint: a bit for each bit that is 1 in over half of k hashes."""
    return int.from_bytes(np.packbits(2 * counts > k).tobytes(), "big")


def fingerprint(text: str | None, n: int, seeds: tuple[int, ...]) -> list[int]:
    """One 64-bit fingerprint for each seed: the first is XXH64's over the n-word shingles, each further one scrambles these hashes."""
    import xxhash

    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return [0] * len(seeds)
    line, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *[e + 1 for e in ends[:-1]]]
    k = max(1, len(words) - n + 1)
    last = min(n, len(words)) - 1
    digest, seed = xxhash.xxh64_intdigest, seeds[0]
    total = np.zeros((len(seeds), 64), np.int64)
    for lo in range(0, k, 65_536):
        hi = min(k, lo + 65_536)
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo + last : hi + last])], np.uint64)
        for i, other in enumerate(seeds):
            own = h if i == 0 else _scramble(h, other)
            total[i] += bit_counts(own)
    return [majority(t, k) for t in total]


def fingerprints(text: Column, n: int = 4, seeds: tuple[int, ...] = (42,)) -> Column:
    """array<long>: the fingerprint, 64 bits a seed."""

    @F.pandas_udf("array<long>")
    def own(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.begin("simhash")
        for s in texts:
            yield pd.Series([np.array(fingerprint(t, n, seeds), np.uint64).view(np.int64) for t in s], dtype=object)

    return own(text)


def keys(words: int, threshold: int, j: int) -> list[list[tuple[int, int, int]]]:
    """The keys of a fingerprint of `words` longs, each a list of (long, first bit, width); [] if these would be too short or too long."""
    p, bits = threshold // 2 + 1 if j == 1 else threshold + j - 1, 64 * words
    edges = [bits * i // p for i in range(p + 1)]
    shortest, longest = (f(b - a for a, b in zip(edges, edges[1:])) * j for f in (min, max))
    if shortest < SHORTEST or longest > LONGEST:
        return []
    pieces = [[(w, max(a - 64 * w, 0), min(b, 64 * w + 64) - max(a, 64 * w)) for w in range(a // 64, (b - 1) // 64 + 1)] for a, b in zip(edges, edges[1:])]
    return [sum(c, []) for c in combinations(pieces, j)]


def keys_for(n: int, words: int, threshold: int) -> list[list[tuple[int, int, int]]]:
    """Those of the least j at which not over LIVING of n fingerprints live at an anchor in the mean, or of the largest j there is."""
    found: list[list[tuple[int, int, int]]] = []
    for j in range(1, 64 * words):
        if more := keys(words, threshold, j):
            found = more
            if n <= LIVING << min(sum(w for _, _, w in k) for k in found) - 4:
                break
        elif found:
            break
    if not found:
        raise ValueError(f"no keys find all links at {threshold} of {64 * words} bits")
    return found


def _home(x: Column) -> Column:
    """The code word within 1 of x: the lowest 15 bits are corrected by their syndrome, the rest stays."""
    syndrome = F.lit(0)
    for j in range(4):
        mask = sum(1 << (p - 1) for p in range(1, 16) if p >> j & 1)
        syndrome = syndrome + F.when(F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) % 2 == 1, 1 << j).otherwise(0)
    return F.when(syndrome == 0, x).otherwise(x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (syndrome - 1).cast("int"))))


def numbered_keys(fp: str, keys: list[list[tuple[int, int, int]]]) -> Column:
    """array<struct<k, x, width>>: the keys of a fingerprint, numbered."""
    def of_key(k: int, pieces: list[tuple[int, int, int]]) -> Column:
        x, at = F.lit(0).cast("long"), 0
        for word, bit, width in pieces:
            own = F.shiftrightunsigned(F.element_at(F.col(fp), word + 1), bit).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            x, at = x.bitwiseOR(F.shiftleft(own, at)), at + width
        return F.struct(F.lit(k).cast("long").alias("k"), x.alias("x"), F.lit(at).alias("width"))

    return F.array(*[of_key(k, pieces) for k, pieces in enumerate(keys)])


def stops(key: str, longest: int) -> Column:
    """array<long> of 2 * anchor + lives: the anchor at which a key of a fingerprint lives (lives = 1) and those it visits."""
    k, x, width = (F.col(f"{key}.{c}") for c in ("k", "x", "width"))
    flips = F.slice(F.array(*[F.lit(0 if b < 0 else 1 << b).cast("long") for b in range(-1, longest)]), F.lit(1), width + 1)
    # the homes of all values within t = 1: just the anchors within R + t, for a perfect code
    visits = F.array_distinct(F.transform(flips, lambda m: _home(x.bitwiseXOR(m))))
    return F.transform(visits, lambda a: k * (1 << LONGEST + 2) + a * 2 + F.when(a == _home(x), 1).otherwise(0))


def crowded(nodes: DataFrame, found: list[list[tuple[int, int, int]]], longest: int) -> DataFrame:
    """(at, blocks): anchors to which keys of over THIN fingerprints bring more than CROWD, and in how many blocks these go (3 or more)."""
    shared = nodes.select(F.explode(numbered_keys("fp", found)).alias("key")).groupBy("key").count().where(F.col("count") > THIN)
    at = shared.select(F.explode(stops("key", longest)).alias("anchor"), "count").groupBy(F.shiftright("anchor", 1).alias("at")).agg(F.sum("count").alias("n"))
    return common.cut(at.where(F.col("n") > CROWD).select("at", F.ceil(F.col("n") * 2 / CROWD).cast("int").alias("blocks")), "crowded")


def cells(node: str, blocks: str) -> Column:
    """array<int>: the pairs of blocks, numbered, in which a node takes part at an anchor of so many blocks; just 0 at one that has none."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col(blocks) - 1), lambda i: i != own)
    return F.when(F.col(blocks).isNull(), F.array(F.lit(0))).otherwise(F.transform(others, lambda i: F.least(i, own) * F.col(blocks) + F.greatest(i, own)))


def _grow(fp: np.ndarray, lives: np.ndarray, node: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that span the groups of one anchor, breadth first from those that live there: these are compared with all ungrouped, visitors with those that live there."""
    out = []
    hosts, guests = np.flatnonzero(lives), np.flatnonzero(~lives)
    while len(hosts):
        queue, hosts = [hosts[0]], hosts[1:]
        while queue and (len(hosts) or len(guests)):
            x = queue.pop()
            near = np.bitwise_count(fp[hosts] ^ fp[x]).sum(axis=1) <= threshold
            met, hosts = hosts[near], hosts[~near]
            if lives[x]:
                near = np.bitwise_count(fp[guests] ^ fp[x]).sum(axis=1) <= threshold
                met, guests = np.concatenate([met, guests[near]]), guests[~near]
            out += [(int(node[x]), int(node[y])) for y in met]
            queue += met.tolist()
    return out


def links(nodes: DataFrame, words: int, threshold: int) -> DataFrame:
    """nodes: (node, fp), distinct fingerprints, written. (a, b): links that span every group of fingerprints within the threshold."""

    own = [f"f{i}" for i in range(words)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("simhash")
        held: list[pd.DataFrame] = []

        low: dict[int, int] = {}  # of linked nodes: a smaller one of their group, or themselves

        def find(x: int) -> int:
            while (up := low.setdefault(x, x)) != x:
                low[x] = low[up]
                x = up
            return x

        def stars() -> pd.DataFrame:
            out = [(root, x) for x in list(low) if (root := find(x)) != x]
            low.clear()
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        def run(b: pd.DataFrame) -> None:
            anchor, cell, node = b["anchor"].to_numpy(), b["cell"].to_numpy(), b["node"].to_numpy()
            anchor, lives = anchor >> 1, anchor & 1 == 1
            fp = np.ascontiguousarray(b[own].to_numpy(np.int64)).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
            sizes = np.diff(np.concatenate([starts, [len(b)]]))
            some = np.add.reduceat(lives.astype(np.int64), starts) > 0
            a, c = [], []
            for d in range(1, 48):  # small anchors: all pairs d places apart at once
                size = np.repeat(np.where((sizes <= 48) & some, sizes, 0), sizes)
                place = np.arange(len(b)) - np.repeat(starts, sizes)
                x = np.flatnonzero(place + d < size)
                if not len(x):
                    break
                x = x[lives[x] | lives[x + d]]
                x = x[np.bitwise_count(fp[x] ^ fp[x + d]).sum(axis=1) <= threshold]
                a.append(node[x]), c.append(node[x + d])
            pairs = [(int(p), int(q)) for p, q in zip(np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*c, np.zeros(0, np.int64)]))]
            for s, n in zip(starts[(sizes > 48) & some], sizes[(sizes > 48) & some]):
                pairs += _grow(fp[s : s + n], lives[s : s + n], node[s : s + n], threshold)
            for p, q in pairs:
                p, q = find(p), find(q)
                low[max(p, q)] = min(p, q)

        for b in batches:
            if len(b):
                held.append(b)
                last, cell = b["anchor"].iloc[-1] >> 1, b["cell"].iloc[-1]
                if held[0]["anchor"].iloc[0] >> 1 != last or held[0]["cell"].iloc[0] != cell:  # an anchor's rows may go on in the next batch
                    all_rows = pd.concat(held, ignore_index=True)
                    done = (all_rows["anchor"] // 2 != last) | (all_rows["cell"] != cell)
                    run(all_rows[done])
                    if len(low) > LINKED_NODES:
                        yield stars()
                    held = [all_rows[~done].reset_index(drop=True)]
        if held:
            run(pd.concat(held, ignore_index=True))
        yield stars()
        common.give_back()

    n = nodes.count()
    found = keys_for(n, words, threshold)
    longest = max(sum(w for _, _, w in k) for k in found)
    blocks = crowded(nodes, found, longest)
    # a written table of fingerprints is a few small files, its keys are not
    spread = nodes.repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, n // SPREAD_NODES), "node")
    spread = spread.select("node", *[F.element_at("fp", i + 1).alias(c) for i, c in enumerate(own)], F.explode(numbered_keys("fp", found)).alias("key"))
    spread = spread.select("node", *own, F.explode(stops("key", longest)).alias("anchor"))
    spread = spread.join(blocks, F.shiftright("anchor", 1) == F.col("at"), "left").select("node", *own, "anchor", F.explode(cells("node", "blocks")).alias("cell"))
    return spread.repartition(F.shiftright("anchor", 1), "cell").sortWithinPartitions("cell", "anchor", "node").mapInPandas(compare, "a long, b long")


def classes(prints: DataFrame, words: int, threshold: int) -> DataFrame:
    """prints: (fp, id). (fp, component): the smallest id reachable over links, itself included; null ids count last.

    Nodes are numbered in the order of their smallest ids, null ids after all others. A linked group without any id
    has the hash of its first fingerprint.
    """
    # numbers grow over range partitions; written, they stay
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).orderBy(F.col("least").asc_nulls_last(), "fp")
    nodes = common.cut(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = components(links(nodes.select("node", "fp"), words, threshold))
    labels = nodes.select(F.col("node").alias("component"), F.coalesce("least", F.xxhash64("fp")).alias("label"))
    joined = nodes.join(found, "node", "left").join(labels, "component", "left")
    return joined.select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("label")).alias("component"))


def near_duplicates(docs: DataFrame, n: int = 4, threshold: int = 4, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp array<long>, component) of every row."""
    src = common.small_batches(docs.select(F.col(id_col).cast("long").alias("id"), fingerprints(F.col(text_col), n, seeds).alias("fp")))
    prints = common.cut(src, "prints")
    # written, the classes are a plain side of the join: a fingerprint that a third of all rows share can be split
    return prints.join(common.cut(classes(prints, len(seeds), threshold), "classes"), "fp").select("id", "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
