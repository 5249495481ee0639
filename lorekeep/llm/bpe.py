"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Python worker.

A worker splits its texts by the tokenizer's pattern and encodes each distinct piece once. A piece that is a
vocabulary entry is that id. The others become token-position rows; a recursive query joins neighbouring rows with
the merge table and contracts, in every piece, the leftmost pair of least rank, until no piece has a mergeable pair.
Decoding joins ids with the vocabulary and aggregates the bytes in position order.

Memory: texts are taken in units of UNIT characters, of a longer text SLICE pieces at a time; pieces in lots of LOT,
windows in lots of LOT_BYTES; ids are decoded SLICE at a time. The recursion runs in legs of at most LEG rounds, because
DuckDB keeps the rows of all rounds of one recursive query; the dictionary of known pieces is emptied at KNOWN_PIECES.

A piece of over LONG_PIECE bytes is cut into windows of STEP bytes and OVERLAP more, which are encoded like pieces, so
time grows with its length and not with the square. Two neighbours are spliced at a token that both have. That is exact:
any run of tokens of an encoding is the encoding of its bytes, since merges inside it come in the same order whatever
stands beside it; and two encodings X and Y laid end to end are the encoding of both if the last token of X and the
first of Y, which stand side by side in one window, encode to themselves: the first merge over the border would be a
merge of these two as well. Where neighbours share no token (runs of one letter), the piece is encoded as a whole,
contracting all disjoint occurrences of the least pair at once where that is proven equal to one at a time (no merge
with the new token ranks below it).

Null and empty texts give no ids. Repeated rows give repeated results. Only the named columns are read. Vocabularies
have at most 2 ^ 21 ids, else an error.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEG = 32
LONG_PIECE = 192
STEP, OVERLAP = 128, 64
KNOWN_PIECES = 300_000
UNIT = 1 << 20
LOT, LOT_BYTES = 20_000, 1 << 16
SLICE = 1 << 18
SHIFT = 1 << 36

#: One leg: rows are (id, tok, nxt, round) with id = piece * SHIFT + position, positions of a piece without gaps, nxt the token after (-1: none).
_LEG_SQL = """
WITH RECURSIVE leg(id, tok, nxt, round) AS (
  SELECT id, tok, nxt, 0 FROM state
  UNION ALL
  SELECT l.id - (l.id > b.at)::BIGINT, CASE WHEN l.id = b.at THEN b.merged ELSE l.tok END,
    CASE WHEN l.id = b.at THEN b.after WHEN l.id = b.at - 1 THEN b.merged ELSE l.nxt END, l.round + 1
  FROM leg l JOIN (
    SELECT c.piece, c.at, c.merged, s.nxt AS after FROM (
      SELECT x.id >> 36 AS piece, min((m.merged << 36) + (x.id & {low})) AS least,
             least >> 36 AS merged, (piece << 36) + (least & {low}) AS at
      FROM leg x JOIN merges m ON m.pair = (x.tok << 21) + x.nxt
      GROUP BY 1) c JOIN leg s ON s.id = c.at + 1) b ON b.piece = l.id >> 36
  WHERE l.id <> b.at + 1 AND l.round < {leg})
SELECT id, tok, round FROM leg
""".format(low=SHIFT - 1, leg=LEG)

#: The same for long pieces: all disjoint occurrences of the least pair, or only the leftmost if its token is not safe.
_LONG_LEG_SQL = """
WITH RECURSIVE leg(id, tok, round) AS (
  SELECT id, tok, 0 FROM state
  UNION ALL
  SELECT id - taken_before, CASE WHEN taken THEN merged ELSE tok END, round + 1 FROM (
    SELECT l.id, l.tok, l.round, b.merged, t.id IS NOT NULL AS taken,
      count(t.id) OVER (PARTITION BY l.id // {shift} ORDER BY l.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken_before,
      coalesce(lag(t.id IS NOT NULL) OVER (PARTITION BY l.id // {shift} ORDER BY l.id), false) AS gone
    FROM leg l
    JOIN (SELECT x.id // {shift} AS piece, min(m.merged) AS merged
          FROM leg x JOIN leg y ON y.id = x.id + 1 JOIN merges m ON m.pair = (x.tok << 21) + y.tok GROUP BY 1) b
      ON b.piece = l.id // {shift}
    LEFT JOIN (
      SELECT id FROM (
        SELECT id, safe, n, row_number() OVER (PARTITION BY id - n ORDER BY id) AS in_run FROM (
          SELECT id, safe, row_number() OVER (PARTITION BY piece ORDER BY id) AS n FROM (
            SELECT x.id, x.id // {shift} AS piece, m.safe, m.merged, min(m.merged) OVER (PARTITION BY x.id // {shift}) AS least
            FROM leg x JOIN leg y ON y.id = x.id + 1 JOIN merges m ON m.pair = (x.tok << 21) + y.tok) p
          WHERE merged = least) q)
      WHERE (safe AND in_run % 2 = 1) OR (NOT safe AND n = 1)) t ON t.id = l.id
    WHERE l.round < {leg})
  WHERE NOT gone)
SELECT id, tok, round FROM leg
""".format(shift=SHIFT, leg=LEG)


class Codec:
    """The vocabulary of a rank file in an in-memory DuckDB; encodes pieces and decodes ids."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= 1 << 21:
            raise ValueError("ids of 2 ^ 21 and more")
        self.pattern = regex.compile(pattern)
        left, right, merged = [], [], []
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                if (a := self.ranks.get(piece[:i])) is not None and (b := self.ranks.get(piece[i:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        left, right, merged = (np.array(x, np.int64) for x in (left, right, merged))
        unsafe = np.union1d(left[merged < left], right[merged < right])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB", "temp_directory": ""})
        self.db.register("m", pa.table({"pair": (left << 21) + right, "merged": merged, "safe": ~np.isin(merged, unsafe)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"tok": np.array(list(self.ranks.values()), np.int32), "piece": [k.hex() for k in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.piece_of = {i: k for k, i in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.digits = [str(i) for i in range(max(self.ranks.values()) + 1)]
        self.whole = {s: i for k, i in self.ranks.items() if (s := k.decode("utf-8", "replace")).encode() == k}
        self._clear()

    def _clear(self) -> None:
        """Know just the vocabulary's own pieces."""
        self.known = {s: i for i, s in enumerate(self.whole)}
        self.used = len(self.whole)
        self.pool = np.concatenate([np.array(list(self.whole.values()), np.int32), np.zeros(1 << 18, np.int32)])
        self.decimal = [self.digits[i] for i in self.whole.values()]
        self.place = np.zeros(1 << 20, np.int64)  # of each known piece: where its ids begin in the pool; one more entry has the end
        self.place[: self.used + 1] = np.arange(self.used + 1)

    def contract(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece, by recursive contraction from single bytes."""
        short = [p if len(p) <= LONG_PIECE else b"" for p in pieces]
        out = [ids for k in range(0, len(short), LOT) for ids in self._rounds(short[k : k + LOT], _LEG_SQL)]
        for i, p in enumerate(pieces):
            if len(p) > LONG_PIECE:
                out[i] = self._spliced(p)
        return out

    def _spliced(self, piece: bytes) -> list[int]:
        """The ids of a long piece from those of overlapping windows."""
        starts = range(0, max(1, len(piece) - OVERLAP), STEP)
        ids: list[int] = []
        ends = np.zeros(0, np.int64)  # where each id's bytes end
        lot = max(1, LOT_BYTES // (STEP + OVERLAP))
        for k in range(0, len(starts), lot):
            mine = starts[k : k + lot]
            for at, own in zip(mine, self._rounds([piece[s : s + STEP + OVERLAP] for s in mine], _LEG_SQL)):
                own_ends = at + np.cumsum([len(self.piece_of[i]) for i in own])
                if at:
                    lo = max(0, int(np.searchsorted(ends, at)) - 1)
                    before = {(int(e), ids[lo + j]): lo + j for j, e in enumerate(ends[lo:])}
                    # the same id with the same end is the same token; a window's first and last ones are the least sure
                    both = [(abs(2 * int(e) - 2 * at - OVERLAP), before[int(e), i], j) for j, (e, i) in enumerate(zip(own_ends, own)) if (int(e), i) in before]
                    if not both:
                        return self._rounds([piece], _LONG_LEG_SQL)[0]
                    _, x, y = min(both)
                    ids, ends, own, own_ends = ids[: x + 1], ends[: x + 1], own[y + 1 :], own_ends[y + 1 :]
                ids += own
                ends = np.concatenate([ends, own_ends])
        return ids

    def _rounds(self, pieces: list[bytes], leg: str) -> list[list[int]]:
        import pyarrow as pa

        out: list[list[int]] = [[] for _ in pieces]
        mine = [i for i, p in enumerate(pieces) if p]
        lengths = np.array([len(pieces[i]) for i in mine], np.int64)
        data = np.frombuffer(b"".join(pieces[i] for i in mine), np.uint8)
        ids = common.ragged(np.arange(len(mine), dtype=np.int64) * SHIFT, lengths)
        tok = self.of_byte[data]
        while len(ids):
            nxt = np.append(tok[1:], -1)
            nxt[:-1][ids[1:] // SHIFT != ids[:-1] // SHIFT] = -1
            self.db.register("state", pa.table({"id": ids, "tok": tok, "nxt": nxt}))
            got = self.db.execute(leg).fetchnumpy()
            self.db.unregister("state")
            gid, gtok, ground = (np.asarray(got[k]).astype(np.int64) for k in ("id", "tok", "round"))
            last = np.zeros(len(mine), np.int64)
            np.maximum.at(last, gid // SHIFT, ground)
            keep = ground == last[gid // SHIFT]
            gid, gtok = gid[keep], gtok[keep]
            order = np.argsort(gid, kind="stable")
            gid, gtok = gid[order], gtok[order]
            over = last[gid // SHIFT] < LEG
            where, done = gid[over] // SHIFT, gtok[over].tolist()
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            for w, x, y in zip(where[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(done)]):
                out[mine[w]] = done[x:y]
            ids, tok = gid[~over], gtok[~over]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Add the pieces that are not known."""
        fresh = list(set(pieces).difference(self.known))
        for k in range(0, len(fresh), LOT):
            part = fresh[k : k + LOT]
            made = self.contract([p.encode("utf-8", "surrogatepass") for p in part])
            n = sum(map(len, made))
            while self.used + n > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
            self.pool[self.used : self.used + n] = [i for ids in made for i in ids]
            first, digits = len(self.decimal), self.digits
            while first + len(part) >= len(self.place):
                self.place = np.concatenate([self.place, np.zeros(len(self.place), np.int64)])
            self.place[first + 1 : first + len(part) + 1] = self.used + np.cumsum([len(ids) for ids in made])
            self.used += n
            self.known.update(zip(part, range(first, first + len(part))))
            self.decimal += [",".join([digits[x] for x in ids]) for ids in made]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids one text after the other, the number of ids of each text, and each text's ids as decimals joined by commas."""
        collects = gc.isenabled()
        gc.disable()  # no cycles are made below, but so many lists that the collector would walk the dictionary again and again
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        ids, counts, at = self._ids(pieces)
        return ids, counts, [",".join([self.decimal[i] for i in own]) for own in at]

    def _ids(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """All ids, the number of ids of each text, and each text's pieces as numbers in the dictionary."""
        if len(self.known) > KNOWN_PIECES:
            self._clear()
        self.learn([p for own in pieces for p in own])
        at = [list(map(self.known.__getitem__, own)) for own in pieces]
        first = np.cumsum([0, *map(len, at)])
        rows = np.fromiter(chain.from_iterable(at), np.int64, int(first[-1]))
        starts = self.place[rows]
        lengths = self.place[rows + 1] - starts
        ids = self.pool[common.ragged(starts, lengths)]
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])
        return ids, counts, at

    def slices(self, text: str) -> Iterator[tuple[np.ndarray, str]]:
        """A long text's ids and their decimals joined by commas, SLICE pieces at a time."""
        found = (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(found, SLICE)):
            ids, _, (at,) = self._ids([pieces])
            yield ids, ",".join([self.decimal[i] for i in at])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each document's ids: join with the vocabulary, aggregate in position order, SLICE ids at a time. An unknown id is an error."""
        import pyarrow as pa

        doc = np.repeat(np.arange(len(counts)), counts)
        if len(ids) and not set(np.unique(ids).tolist()) <= self.piece_of.keys():
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(counts)
        for lo in range(0, len(ids), SLICE):
            hi = min(len(ids), lo + SLICE)
            self.db.register("tokens", pa.table({"doc": doc[lo:hi].astype(np.int32), "pos": np.arange(hi - lo, dtype=np.int32), "tok": ids[lo:hi].astype(np.int32)}))
            # the database has one thread, which aggregates rows as they come: sorting all once replaces a sort in every group
            got = self.db.execute("SELECT doc, string_agg(piece, '') AS bytes FROM (SELECT doc, piece FROM tokens JOIN vocabulary USING (tok) ORDER BY pos) GROUP BY doc").fetchall()
            self.db.unregister("tokens")
            for d, hexed in got:
                out[d] += bytes.fromhex(hexed)
        return out


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process; tasks that follow in the process use it again."""
    return Codec(ranks_path, pattern)


common.HELD["bpe"] = codec.cache_clear


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null and empty texts give an empty array."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("bpe")
        c = codec(ranks_path, pattern)
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in common.units(texts, UNIT):
                if hi - lo == 1 and len(texts[lo] or "") > UNIT:
                    own = [np.concatenate([ids for ids, _ in c.slices(texts[lo])])]
                else:
                    ids, counts, _ = c.encode(texts[lo:hi])
                    own = np.split(ids, np.cumsum(counts)[:-1])
                yield pd.DataFrame({"id": b["id"].iloc[lo:hi].array, "ids": own})

    src = common.small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(work, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of every row of ids; null and empty arrays give no bytes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("bpe")
        c = codec(ranks_path, pattern)
        for b in batches:
            own = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in b["ids"]]
            yield pd.DataFrame({"id": b["id"].array, "bytes": c.decode(np.concatenate([*own, np.zeros(0, np.int64)]), np.array([len(x) for x in own]))})

    src = common.small_batches(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(work, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass that ships only digests back."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.begin("bpe")
        c = codec(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in common.units(texts, UNIT):
                if hi - lo == 1 and len(texts[lo] or "") > UNIT:
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for ids, decimals in c.slices(texts[lo]):
                        of_ids.update((("," if n else "") + decimals).encode())
                        of_bytes.update(c.decode(ids, np.array([len(ids)]))[0])
                        n += len(ids)
                    yield pd.DataFrame({"id": b["id"].iloc[lo:hi].array, "n_tokens": [n], "ids_sha256": [of_ids.hexdigest()], "decoded_sha256": [of_bytes.hexdigest()]})
                    continue
                ids, counts, decimals = c.encode(texts[lo:hi])
                yield pd.DataFrame({
                    "id": b["id"].iloc[lo:hi].array,
                    "n_tokens": counts,
                    "ids_sha256": [sha(x.encode()) for x in decimals],
                    "decoded_sha256": [sha(x) for x in c.decode(ids, counts)],
                })
        common.give_back()

    src = common.small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
