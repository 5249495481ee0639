"""Decisions and tasks: matching is fuzzy, not transitive and depends on order, so each project is folded in order, its rows passing by one at a time.

What a text is like depends on its key alone, so keys are compared and not rows: a key that came before is looked up, a
new one is compared only with those that can be like it: an index of the kept keys gives those that are equal, that share
two tokens, or that have as many tokens and about as many letters. A row costs what it brings, however many came before.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorekeep.functions.text import STOP
from lorekeep.sources.runtime import ship

from .document import TASK_FIELDS

_STOP = re.compile(rf"\b({STOP})\b")
_TOKEN = re.compile(r"[\w+#.]+")
_RANK = {"LOW": 0, "HIGH": 2}


def key(text: str) -> str:
    return " ".join(_TOKEN.findall(_STOP.sub(" ", text.casefold().replace("ё", "е"))))


class Probe:
    """A text's key and token set, made once."""

    def __init__(self, text: str):
        self.key = key(text)
        self.tokens = frozenset(self.key.split())

    def shares(self, other: "Probe") -> bool:
        """Equal keys, or enough shared tokens."""
        if not self.key or not other.key:
            return False
        a, b = self.tokens, other.tokens
        both = len(a & b)
        return self.key == other.key or both >= 2 and (both >= 0.75 * len(a | b) or (both == min(len(a), len(b)) and abs(len(a) - len(b)) <= 1))

    def spelled(self, other: "Probe") -> bool:
        """As many tokens, and nearly the same letters; self is the text that was there before."""
        if not self.key or not other.key or len(self.tokens) != len(other.tokens):
            return False
        short, long = sorted((len(self.key), len(other.key)))
        if short < long * 9 / 11:  # a ratio of 0.9 needs these lengths
            return False
        m = SequenceMatcher(None, self.key, other.key)
        return m.quick_ratio() >= 0.9 and m.ratio() >= 0.9

    def like(self, other: "Probe") -> bool:
        return self.shares(other) or self.spelled(other)

    def named_by(self, reference: "Probe") -> bool:
        return bool(self.key and reference.key) and (Probe(self.key).like(Probe(reference.key)) or reference.tokens <= self.tokens)


@lru_cache(1 << 14)
def probe(text: str) -> Probe:
    return Probe(text)


@lru_cache(1 << 16)
def _like(kept: str, new: str) -> bool:
    """Probe.like of two keys that were made already."""
    return _keyed(kept).like(_keyed(new))


@lru_cache(1 << 14)
def _keyed(k: str) -> Probe:
    p = Probe("")
    p.key, p.tokens = k, frozenset(k.split())
    return p


class Kept:
    """Numbered texts, and which of them are like another one."""

    def __init__(self):
        self.probes: dict[int, Probe] = {}
        self.by_key, self.by_token, self.by_size = defaultdict(set), defaultdict(set), defaultdict(set)

    def add(self, n: int, p: Probe) -> None:
        self.probes[n] = p
        for index, k in self._places(p):
            index[k].add(n)

    def drop(self, n: int) -> None:
        for index, k in self._places(self.probes.pop(n)):
            index[k].discard(n)
            if not index[k]:
                del index[k]

    def _places(self, p: Probe):
        return [(self.by_key, p.key), (self.by_size, (len(p.tokens), len(p.key))), *[(self.by_token, x) for x in p.tokens]]

    def like(self, p: Probe) -> set[int]:
        if not p.key:
            return set()
        met = Counter(n for x in p.tokens for n in self.by_token.get(x, ()))
        out = {n for n in {*self.by_key.get(p.key, ()), *(n for n, c in met.items() if c > 1)} if self.probes[n].shares(p)}
        long = len(p.key)
        sized = (self.by_size.get((len(p.tokens), k), ()) for k in range(long * 9 // 11, long * 11 // 9 + 2))  # a little more than spelled() lets through
        return out | {n for near in sized for n in near if n not in out and _like(self.probes[n].key, p.key)}

    def holding(self, tokens: frozenset[str]) -> set[int]:
        """Those that have all the tokens, of which there is one at least."""
        sets = sorted((self.by_token.get(x, set()) for x in tokens), key=len)
        return sets[0].intersection(*sets[1:])


def _value(e: dict) -> tuple:
    return e["source"], None if e["source_blocks"] is None else tuple(e["source_blocks"]), e["observed_at"]


def _absorb(item: dict, new: dict) -> None:
    """Blocks are a set and evidence is known by value until _done."""
    if "_seen" not in item:
        item["_blocks"], item["evidence"], item["_seen"] = {*item["blocks"]}, [*item["evidence"]], {*map(_value, item["evidence"])}
    item["_blocks"].update(new["blocks"])
    fresh = [e for e in new["evidence"] if _value(e) not in item["_seen"]]
    item["evidence"] += fresh
    item["_seen"].update(map(_value, fresh))
    if _RANK.get(new["confidence"], 1) > _RANK.get(item["confidence"], 1):
        item["confidence"] = new["confidence"]
    if new["status"] in ("disputed", "superseded"):
        item["status"] = new["status"]


def _done(item: dict) -> dict:
    if item.pop("_seen", None) is not None:
        item["blocks"] = sorted(item.pop("_blocks"))
    return item


def fold_decisions(rows: Iterable[dict]) -> list[dict]:
    """Stored decisions stay as they are. The first similar one absorbs a new decision; one that is new supersedes those its `previous` names.

    Items never go and the first similar one counts, so the item that absorbs a key once does so ever after. Superseding
    is noted by key and time; at the end it goes to the key's items whose status wasn't set later.
    """
    kept, named, items = Kept(), Kept(), []
    number, first, twin, of_key, gone, was_set = {}, [], {}, [], {}, {}
    for now, r in enumerate(rows):
        text = (r["text"] or "").strip()
        if not text and not r["is_old"]:
            continue
        mine = probe(text)
        if not r["is_old"]:
            if mine.key not in twin and (like := kept.like(mine)):
                twin[mine.key] = min(first[k] for k in like)
            if mine.key in twin:
                item = items[twin[mine.key]]
                _absorb(item, r)
                if r["status"] in ("disputed", "superseded"):
                    was_set[twin[mine.key]] = now
                item.update({k: r[k] for k in ("reason", "date", "previous") if r[k]})
                continue
            if (r["previous"] or "").strip() and (old := probe(r["previous"].strip())).key:
                for k in kept.holding(old.tokens) | named.like(probe(old.key)):
                    gone[k] = now
            if mine.key:
                twin[mine.key] = len(items)
        if mine.key and mine.key not in number:
            k = number[mine.key] = len(first)
            first.append(len(items))
            kept.add(k, mine)
            named.add(k, probe(mine.key))
        of_key.append((number.get(mine.key), now))
        items.append(r | {"field": "decisions"})
    for n, (k, made) in enumerate(of_key):
        if gone.get(k, -1) > was_set.get(n, made):
            items[n]["status"] = "superseded"
    return [_done(r) for r in items]


#: With more keys alive than this an index finds those that are alike.
FEW = 64


def fold_tasks(rows: Iterable[dict]) -> list[dict]:
    """Stored tasks stay in their lists. A new task takes all similar ones out of every list, goes on with the first one's id and history under its own title and status."""
    order = {f: i for i, f in enumerate(TASK_FIELDS)}
    of_status = {s: f for f, s in TASK_FIELDS.items()}
    items: dict[int, dict] = {}
    alive: dict[str, list[int]] = {}  # by key; a new task leaves one item of its key
    kept, number = None, {}
    for n, r in enumerate(rows):
        title = (r["text"] or "").strip()
        if not title and not r["is_old"]:
            continue
        mine = probe(title).key
        if r["is_old"]:
            items[n] = r
        else:
            field = of_status.get(r["status"], "todo_tasks")
            if not mine:
                like = []
            elif len(alive) <= FEW:
                like = [k for k in alive if _like(k, mine)]
            else:
                if kept is None:
                    kept, number = Kept(), {}
                    for k, at in alive.items():
                        number[k] = at[0]
                        kept.add(at[0], _keyed(k))
                like = [kept.probes[i].key for i in kept.like(_keyed(mine))]
            task = dict(r)
            if like:
                off = sorted((i for k in like for i in alive[k]), key=lambda i: (order[items[i]["field"]], i))
                task = dict(items[off[0]])
                _absorb(task, r)
                for i in off:
                    del items[i]
                for k in like:
                    del alive[k]
                    if kept is not None and k != mine:
                        kept.drop(number.pop(k))
            task.update(text=r["text"], status=TASK_FIELDS[field], field=field)
            items[n] = task
        if mine:
            alive.setdefault(mine, []).append(n)
            if kept is not None and mine not in number:
                number[mine] = n
                kept.add(n, _keyed(mine))
    return sorted(map(_done, items.values()), key=lambda r: order[r["field"]])  # stable: each list in the order in which its items came


SCHEMA = "project string, field string, pos long, id string, text string, status string, confidence string, blocks array<int>, evidence array<struct<source:string,source_blocks:array<int>,observed_at:string>>, reason string, date string, previous string"
BATCH = 10_000


class _Memo(dict):
    """What rows of the same text share is made once; it is emptied when it has grown."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, x):
        if len(self) >= BATCH:
            self.clear()
        self[x] = out = self.make(x)
        return out


def fold(items: DataFrame, kind: str) -> DataFrame:
    """items: (project, field, pos, is_old, id, text, status, confidence, blocks, evidence, reason, date, previous); kind: decisions or tasks. pos of the result is the place in its list.

    Rows come sorted by (project, is_old desc, list, pos); many small projects share a task, and of a large one only the
    items that there are by then are held. Rows of one place are told apart by what they hold, so reruns agree.
    """
    own = fold_decisions if kind == "decisions" else fold_tasks
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    cols = ["project", "field", "pos", "is_old", "id", "text", "status", "confidence", "reason", "date", "previous"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        histories, same = _Memo(json.loads), _Memo(lambda x: x)
        for b in batches:
            got = {c: b.column(c).to_pylist() for c in [*cols, "history"]}
            for c in ("project", "field", "id", "text", "status", "confidence"):
                got[c] = [same[x] for x in got[c]]
            for *r, h in zip(*got.values()):
                yield dict(zip(cols, r)) | histories[h]

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, group in groupby(rows(batches), itemgetter("project")):
            places: Counter = Counter()
            for r in own(group):
                out.append({**r, "pos": places[r["field"]]})
                places[r["field"]] += 1
                if len(out) == BATCH:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    ship(items.sparkSession)
    # blocks and evidence cross as text, which is read once for rows that have the same
    lists = [F.coalesce(F.col(c), F.array().cast(items.schema[c].dataType)).alias(c) for c in ("blocks", "evidence")]
    history = F.to_json(F.struct(*lists), {"ignoreNullFields": "false"})
    place = F.when(F.col("is_old"), F.coalesce(F.create_map(*[v for i, f in enumerate(TASK_FIELDS) for v in (F.lit(f), F.lit(i))])[F.col("field")], F.lit(0))).otherwise(0)
    x = items.select(F.col("project").cast("string").alias("project"), *cols[1:], history.alias("history"))
    x = x.repartition("project").sortWithinPartitions("project", F.col("is_old").desc(), place, "pos", *cols[4:], "history")
    return x.mapInArrow(run, SCHEMA)
