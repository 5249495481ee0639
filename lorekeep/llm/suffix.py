"""Suffix-array deduplication by distributed prefix doubling over locally chosen positions.

Ranks are classes of equal strings, given by Spark's sort/hash exchanges on (rank, next) pairs; a position drops out
as soon as its class has one member ("unique"), and the lengths grow until they are past the threshold.

Ranking all bytes would move tens of times the input. Instead every window of `length` bytes is represented by one
position, its anchor: the place in it where a SEED-byte string has the least hash, the leftmost of equals. Equal
windows have their anchors at the same place, so windows need be compared only within one class of anchors.
Consecutive windows share anchors; an anchor stands for a run of windows.

  round 0  anchors are ranked by their SEED bytes; unique ones go, and with them all their windows.
  round 1  an anchor is ranked by the pair (round-0 rank, all bytes of its run of windows with their place). In a class
           of two or more, all windows of the run are repeated. If a round-0 class has just one such class, it is settled.
  round 2  what is left are anchors whose surroundings differ in part. One representative of each round-1 class is
           ranked by the pairs (round-0 rank, the NEXT bytes to the right) and (round-0 rank, the NEXT bytes to the left): every
           window of the run contains one of the two whole. Unique pairs go.
  round 3  the windows of what is left are ranked by themselves: (round-2 rank, window), past the threshold; where a
           round-2 class has at most GROUP members, inside the task that already holds the class.

All hashes that rank are of 64 bits and used in pairs, 128 bits in all. Counts are partial aggregates, so a class that
holds a third of all rows is summed before it is moved; no class of unbounded size is collected.

Null texts are empty; texts shorter than length lose nothing. Repeated rows are copies of each other. Matches don't
cross documents, but may lie in one. Overlaps count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
SEED = 32
GROUP = 8192
#: Characters whose anchors are sought at once; a worker holds about 80 bytes for each. Longer texts are cut into segments
#: of so many windows, which overlap by a window less a byte; a run of windows cut by that counts as two.
UNIT = 1 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(200).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _K1
    h += b
    h ^= h >> np.uint64(29)
    h *= _K2
    h ^= h >> np.uint64(32)
    return h


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every string of `length` bytes in data, by doubling: lengths 1, 2, 4, ... and their sums."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, done, at = _TABLE[data], 1, None, 0
    while True:
        if length & size:
            part = level[at : at + n]
            done = part if done is None else _mix(done, part)
            at += size
        size *= 2
        if size > length:
            return done
        level = _mix(level[: len(level) - size // 2], level[size // 2 :])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (offsets: starts and the end): anchor position, first window, last window (inclusive), and the anchor's seed hash."""
    h = rolling(data, seed)
    width = length - seed + 1
    n_win = len(data) - length + 1
    if n_win <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # least of each run of `width` hashes, leftmost of equals: place in the low bits, hash in the high ones
    low = np.uint64((1 << 26) - 1)
    if len(h) > int(low):
        raise ValueError("unit too large")
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    level, size = key, 1
    while size * 2 <= width:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    least = np.minimum(level[:n_win], level[width - size : width - size + n_win])
    pos = (least & low).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(n_win), side="right") - 1
    inside = np.arange(n_win) + length <= offsets[doc + 1]
    win = np.flatnonzero(inside)
    if not len(win):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = pos[win]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (win[1:] != win[:-1] + 1)])
    first = win[new]
    last = np.concatenate([win[np.flatnonzero(new)[1:] - 1], win[-1:]])
    return p[new], first, last, h[p[new]]


def _layout(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return raw, np.frombuffer(b"".join(raw), np.uint8), offsets


def _digest(x: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x, 77)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _find(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rounds 0 and 1: (row, pos, lo, hi, g, ctx) of every anchor; pos within its text, windows pos - hi .. pos - lo."""
    common.begin("suffix")
    for b in batches:
        texts, rows = b["text"].tolist(), b["row"].to_numpy()
        for a, z in common.units(texts, UNIT):
            _, data, off = _layout(texts[a:z])
            cut = UNIT if z - a == 1 else len(data) + 1
            for begin in range(0, len(data), cut):
                part, ends = (data[begin : begin + cut + length - 1], np.array([0, min(cut + length - 1, len(data) - begin)])) if z - a == 1 else (data, off)
                at, first, last, h = anchors(part, ends, length)
                if not len(at):
                    continue
                flat = part.tobytes()
                doc = np.searchsorted(ends, first, side="right") - 1
                ctx = [_digest(flat[f : l + length]) for f, l in zip(first.tolist(), last.tolist())]
                lo, hi = at - last, at - first
                ctx = _mix(np.array(ctx, np.uint64), (lo * 65_536 + hi).astype(np.uint64))
                yield pd.DataFrame({"row": rows[a:z][doc], "pos": (begin + at - ends[doc]).astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "g": _signed(h), "ctx": _signed(ctx)})
    common.give_back()


def repeated(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """texts: (row, text), row unique. (row, spans array<struct<first, last>>): runs of windows (by first byte, inclusive) that occur elsewhere."""
    src = common.small_batches(texts)
    kind = src.schema["row"].dataType.simpleString()
    schema = f"row {kind}, pos int, lo int, hi int, g long, ctx long"
    found = common.cut(src.mapInPandas(lambda it: _find(it, length), schema), "anchors")

    # lists of classes are written before they are joined: then both sides of the join are plain exchanges, and adaptive
    # execution can split a class that holds a third of all rows
    alive = common.cut(found.groupBy("g").agg(F.count("*").alias("n_g")).where("n_g > 1").select("g"), "alive")
    live = common.cut(found.join(alive, "g"), "live")
    common.discard(found, alive)
    first = [F.first(c).alias(c) for c in ("row", "pos", "lo", "hi")]  # of one and the same row, any of the class
    one = common.cut(live.groupBy("g", "ctx").agg(F.count("*").alias("n"), *first), "classes")

    # round 1: classes of two or more anchors with all their surroundings
    whole = live.join(one.where("n > 1").select("g", "ctx"), ["g", "ctx"]).select("row", (F.col("pos") - F.col("hi")).alias("first"), (F.col("pos") - F.col("lo")).alias("last"))

    # rounds 2 and 3: representatives of classes whose seed occurs in other surroundings too
    varied = common.cut(one.groupBy("g").agg(F.count("*").alias("n_ctx")).where("n_ctx > 1").select("g"), "varied")
    mixed = one.join(varied, "g")
    need = mixed.groupBy("row").agg(F.collect_list(F.struct("pos", "lo", "hi", "g", "ctx", "n")).alias("need"))
    pair = src.join(need, "row").select("row", "text", "need")

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (length - SEED) // 2
        for b in batches:
            out = []
            for row, text, todo in zip(b["row"], b["text"], b["need"]):
                raw = text.encode("utf-8", "surrogatepass")
                for x in todo:
                    p, lo, hi = x["pos"], x["lo"], x["hi"]
                    for right, l, h in ((1, lo, min(hi, half)), (0, max(lo, half + 1), hi)):
                        if l <= h:
                            # all windows p - h .. p - l hold these bytes
                            near = raw[p : p + length - half] if right else raw[p - half - 1 : p + SEED]
                            out.append((x["g"], right, _digest(near), x["n"], row, p - h, p, raw[p - h : p - l + length]))
            d = pd.DataFrame(out, columns=["g", "right", "near", "n", "row", "first", "pos", "bytes"])
            yield d.assign(near=_signed(d["near"].to_numpy(np.uint64) if len(d) else []))
        common.give_back()

    halves = common.cut(common.small_batches(pair).mapInPandas(sides, f"g long, right int, near long, n long, row {kind}, first int, pos int, bytes binary"), "halves")
    size = common.cut(halves.groupBy("g", "right", "near").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    kept = halves.join(size, ["g", "right", "near"])

    def windows(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Of all windows of the rows: place in b, start in the text, and their rank within (g, right, near)."""
        data = np.frombuffer(b"".join(b["bytes"]), np.uint8)
        sizes = b["bytes"].map(len).to_numpy()
        n = sizes - length + 1
        at = common.ragged(np.cumsum(sizes) - sizes, n)
        start = common.ragged(b["first"].to_numpy(np.int64), n)
        place = np.repeat(np.arange(len(b)), n)
        back = (b["pos"].to_numpy(np.int64)[place] - start).astype(np.uint64)
        w = _mix(rolling(data, length)[at], b["near"].to_numpy(np.int64).view(np.uint64)[place])
        return place, start, _mix(w, back)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(b: pd.DataFrame) -> pd.DataFrame:
            place, start, w = windows(b)
            w = _mix(w, b["g"].to_numpy(np.int64).view(np.uint64)[place])
            _, inv, m = np.unique(w, return_inverse=True, return_counts=True)
            use = (m[inv] > 1) & (b["n"].to_numpy() == 1)[place]
            place, start = place[use], start[use]
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])) if len(place) else np.zeros(0, np.int64)
            return pd.DataFrame({"row": b["row"].array[place[new]], "first": start[new], "last": start[np.concatenate([new[1:] - 1, [len(start) - 1]])] if len(new) else start})

        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n >= 4096:
                every = pd.concat(held, ignore_index=True)
                end = every[["g", "right", "near"]].iloc[-1]
                over = ((every[["g", "right", "near"]] != end).any(axis=1)).to_numpy()
                if over.any():
                    yield run(every[over].reset_index(drop=True))
                held = [every[~over].reset_index(drop=True)]
                n = len(held[0])
        if held:
            yield run(pd.concat(held, ignore_index=True))
        common.give_back()

    key = ["g", "right", "near"]
    few = kept.where(F.col("m") <= GROUP).repartition(*key).sortWithinPartitions(*key).mapInPandas(inside, f"row {kind}, first int, last int")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 4096):
                own = b.iloc[k : k + 4096].reset_index(drop=True)
                place, start, w = windows(own)
                row = own["row"].where(own["n"] == 1, None).array[place]
                yield pd.DataFrame({"g": own["g"].to_numpy()[place], "w": _signed(w), "row": row, "first": start})

    each = kept.where(F.col("m") > GROUP).mapInPandas(spread, f"g long, w long, row {kind}, first int")
    many = common.cut(each, "windows")
    twice = common.cut(many.groupBy("g", "w").agg(F.count("*").alias("m")).where("m > 1").select("g", "w"), "twice")
    many = many.where("row IS NOT NULL").join(twice, ["g", "w"]).select("row", "first", F.col("first").alias("last"))
    return whole.unionByName(few).unionByName(many).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def merge(spans, n_bytes: int, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges [a, b)."""
    out: list[list[int]] = []
    for f, l in sorted((x["first"], x["last"]) for x in spans) if spans is not None else []:
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], l + length)
        else:
            out.append([f, l + length])
    return [(a, b) for a, b in out]


def _cut_out(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts, own = common.numbered(texts, "id")
    texts = texts.withColumnRenamed(own, "row")
    spans = repeated(texts.select("row", "text"), length)
    id_type = texts.schema["id"].dataType.simpleString()
    joined = texts.join(common.cut(spans, "spans"), "row", "left").select("id", "text", "spans")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, s in zip(b["id"], b["text"], b["spans"]):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                ranges = merge(s, len(raw), length)
                kept = _cut_out(raw, ranges)
                out.append((i, len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return common.small_batches(joined).mapInPandas(work, schema).withColumnRenamed("id", id_col)


def with_kept_text(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to what stays, and _n_removed, the bytes cut. Characters that lose a byte go whole."""
    src, own = common.numbered(docs, id_col)
    spans = common.cut(repeated(src.select(F.col(own).alias("row"), F.col(text_col).alias("text")), length), "spans")

    @F.pandas_udf("text string, n long")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans):
            if t is None or s is None:
                out.append((t, 0))
                continue
            raw = t.encode("utf-8", "surrogatepass")
            kept = _cut_out(raw, merge(s, len(raw), length))
            out.append((kept.decode("utf-8", "ignore"), len(raw) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n"])

    d, s = common.small_batches(src).alias("d"), spans.alias("s")
    joined = d.join(s, F.col(f"d.{own}") == F.col("s.row"), "left").select("d.*", keep(F.col(f"d.`{text_col}`"), F.col("s.spans")).alias(f"{own}_kept"))
    return joined.select(*[F.col(f"{own}_kept.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.coalesce(f"{own}_kept.n", F.lit(0)).alias("_n_removed"))
