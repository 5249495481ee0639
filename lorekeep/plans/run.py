"""The whole run: a history in, documents of its projects brought up to date and stored.

    python -m lorekeep.plans.run HISTORY --store FOLDER [--update] [--projects a,b] [--yes]

Everything up to the documents is one set of DataFrames for all projects. All are checked before the first is stored; the
commits are then one by one, and what fails doesn't hold up the others.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as t
from lorekeep.operators import chunk, document, extract, reconcile, reduce
from lorekeep.sources import model, transcripts
from lorekeep.sources.runtime import cut
from lorekeep.sources.store import DATA, READABLE, Store

CANDIDATE = "project string, display_name string, aliases array<string>, message_numbers array<int>, confidence string"
DONE, NOTHING_CHOSEN, FAILED, STOPPED = 0, 1, 2, 130


@dataclass
class Outcome:
    code: int
    stored: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def named(spark: SparkSession, names: str) -> DataFrame:
    """Candidates from a comma-separated list. A name that no file could have is an error."""
    raw = spark.createDataFrame([(0, names)], "id int, names string")
    bad = F.raise_error(F.lit("no project name")).cast("string")
    c = reduce.names_from_list(raw, keep_bad=True).select(F.coalesce("project", bad).alias("project"), t.title(F.col("display_name")).alias("display_name"), "pos")
    return c.orderBy("pos").select("project", "display_name", F.array().cast("array<string>").alias("aliases"), F.array().cast("array<int>").alias("message_numbers"), F.lit("HIGH").alias("confidence"))


class Rules:
    """The analyzer that needs no model."""

    def projects(self, messages: DataFrame) -> DataFrame:
        return extract.candidates(messages).orderBy("rank").select("project", "display_name", F.array().cast("array<string>").alias("aliases"), "message_numbers", "confidence")

    def extract(self, messages: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = candidates.crossJoin(messages.select("history_id").distinct())  # one history
        rel = extract.relevant(messages, p)
        lines = extract.lines(rel)
        scalars = extract.summaries(lines, p).select("project", "summary", F.lit("").alias("purpose"))
        return scalars, long_items(extract.items(lines, extract.technologies(rel)))


@dataclass
class Model:
    """The analyzer that asks a model: client(system, user) -> answer."""

    client: Callable[[str, str], str]
    max_chars: int = chunk.DEFAULT_CHARS

    def projects(self, messages: DataFrame) -> DataFrame:
        parts = chunk.pack(chunk.pieces(messages, self.max_chars), self.max_chars)
        return model.find_projects(parts, self.client).orderBy("project").select("project", "display_name", "aliases", "message_numbers", "confidence")

    def extract(self, messages: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = candidates.crossJoin(messages.select("history_id").distinct())
        rel = extract.relevant(messages, p).withColumn("history", F.struct("history_id", "project"))
        parts = chunk.pack(chunk.pieces(rel.drop("history_id").withColumnRenamed("history", "history_id"), self.max_chars), self.max_chars)
        scalars, items = model.extract(parts.select("history_id.*", "number", "part", "role", "date", "text", "chunk"), p, self.client)
        return scalars.drop("history_id"), items.drop("history_id")


def long_items(found: DataFrame) -> DataFrame:
    """Rule items with one position for each (message, line), technologies before the lines of their message."""
    return found.select("project", "field", (F.col("number").cast("long") * 1_000_000 + F.col("line_no") + 1).alias("pos"), "text", "status", "confidence", F.array("number").alias("blocks"), F.lit("").alias("reason"), F.coalesce("date", F.lit("")).alias("date"), F.lit("").alias("previous"))


def files_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(project, DATA and the readable files, a column each)."""
    d = items.where("field = 'decisions'")
    shown = document.render(docs, items.where("field <> 'decisions'"), d)
    return shown.join(document.write_documents(docs, items).withColumnRenamed("content", "data"), "project")


def update(store: Store, messages: DataFrame, analyzer, candidates: DataFrame, source: str, observed_at: str, may_update: bool) -> tuple[DataFrame, dict[str, str | None]]:
    """The files of all candidates, checked, and the version each is based on."""
    spark = store.spark
    names = [r[0] for r in candidates.select("project").collect()]  # as many as one history names
    stored = {n: store.load(n) for n in names}
    there = [n for n in names if stored[n] is not None]
    if there and not may_update:
        raise FileExistsError(f"there is a document of {there[0]} already; it needs update")
    docs = items = None
    for n in there:
        d, i, _ = stored[n]
        docs, items = (d, i) if docs is None else (docs.unionByName(d), items.unionByName(i))
    scalars, found = analyzer.extract(messages, candidates)
    new_docs, new_items = reconcile.reconcile(docs, items, candidates, scalars, found, source, observed_at)
    new_docs, new_items = cut(new_docs, "documents"), cut(new_items, "items")
    files = files_of(new_docs, document.must_be_valid(new_items))
    broken = document.document_errors(files.select("project", F.col("data").alias("content"))).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['project']} {r['place']}: {r['rule']}" for r in broken))
    return files, {n: s and s[2] for n, s in stored.items()}


def run(spark: SparkSession, root: str, history: str | None = None, text: str | None = None, analyzer=None, may_update: bool = False, projects: str | None = None,
        choose: Callable[[list[str]], str | None] | None = None, observed_at: str | None = None, say: Callable[[str], None] = lambda _: None) -> Outcome:
    """One run over a history file, or over a text that stands for one. choose gets the names found and gives None for all of them, or the list wanted, '' for none."""
    store, analyzer = Store(spark, root), analyzer or Rules()
    try:
        if (history is None) == (text is None):
            raise ValueError("a history or a text, one of them")
        messages = transcripts.read_histories(spark, history) if history is not None else transcripts.detect(spark.createDataFrame([("text", text)], "history_id string, raw string"))
        if messages.limit(1).count() == 0:
            raise ValueError("the history is empty")
        source = os.path.basename(history.rstrip("/")) if history is not None else "text"
        candidates = named(spark, projects) if projects else analyzer.projects(messages)
        if not projects and may_update and candidates.limit(1).count() == 0 and (only := store.only_project()):
            candidates = named(spark, only).withColumn("confidence", F.lit("LOW"))
        rows = candidates.collect()
        if choose is None:
            if not rows:
                raise ValueError("no project was found; name some")
        elif (wanted := choose([r["project"] for r in rows])) is not None:
            rows = named(spark, wanted).collect() if wanted else []
        if not rows:
            say("no project chosen, nothing stored")
            return Outcome(NOTHING_CHOSEN)
        candidates = spark.createDataFrame(rows, CANDIDATE)
        now = observed_at or datetime.now().astimezone().isoformat(timespec="seconds")
        files, based_on = update(store, messages, analyzer, candidates, source, now, may_update)
        prepared = files.collect()  # a document a project of one history
    except KeyboardInterrupt:
        return Outcome(STOPPED)
    except Exception as e:
        say(f"error: {e}")
        return Outcome(FAILED, failed={"": str(e)})
    out = Outcome(DONE)
    for r in prepared:
        try:
            store.commit(r["project"], {DATA: r["data"]} | {f: r[c] for c, f in READABLE.items()}, based_on[r["project"]])
            out.stored.append(r["project"])
        except Exception as e:
            out.failed[r["project"]] = str(e)
            say(f"error: {r['project']}: {e}")
    out.code = FAILED if out.failed else DONE
    say(f"stored {len(out.stored)}, failed {len(out.failed)}")
    return out


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Brings the documents of the projects in a chat history up to date.")
    p.add_argument("history", nargs="?", help="a history: text, Markdown, JSON, JSON Lines")
    p.add_argument("--stdin", action="store_true", help="read the history's text from standard input")
    p.add_argument("--store", default="memory", help="folder of the documents")
    p.add_argument("--update", action="store_true", help="change documents that are there")
    p.add_argument("--projects", help="names separated by commas; nothing is detected")
    p.add_argument("--yes", action="store_true", help="take all projects found")
    p.add_argument("--provider", choices=("rules", "llm"), default="rules")
    env = lambda name: os.environ.get(f"LOREKEEP_{name}", "")
    p.add_argument("--api-url", default=env("API_URL"), help="chat completions address; LOREKEEP_API_URL")
    p.add_argument("--api-key", default=env("API_KEY"), help="LOREKEEP_API_KEY")
    p.add_argument("--model", default=env("MODEL"), help="LOREKEEP_MODEL")
    p.add_argument("--chunk-chars", type=int, default=chunk.DEFAULT_CHARS)
    p.add_argument("--llm-timeout", type=float, default=120)
    p.add_argument("--llm-retries", type=int, default=2)
    p.add_argument("--llm-max-response-bytes", type=int, default=2 << 20)
    return p


def analyzer_of(args: argparse.Namespace):
    """Rules, or a model that was named with its address; asking one sends the history away, so it is never a default."""
    chunk.check(args.chunk_chars)
    if args.provider == "rules":
        return Rules()
    if not args.api_url or not args.model:
        raise ValueError("a model needs its address and name")
    endpoint = model.Endpoint(args.api_url, args.model, args.api_key, args.llm_timeout, args.llm_max_response_bytes, args.llm_retries)
    print("the history goes to the model that was named", file=sys.stderr)
    return Model(lambda system, user: model.complete(endpoint, system, user), args.chunk_chars)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(errors="backslashreplace")
    args = options().parse_args(argv)
    tell = lambda x: print(x, file=sys.stderr)
    try:
        if args.stdin == bool(args.history):
            raise ValueError("a history or --stdin, one of them")
        analyzer = analyzer_of(args)
    except ValueError as e:
        tell(f"error: {e}")
        return FAILED

    def choose(found: list[str]) -> str | None:
        print("found: " + (", ".join(found) or "none"))
        return input("Enter for these, or names separated by commas: ").strip() or (None if found else "")

    spark = spark or SparkSession.builder.getOrCreate()
    return run(spark, args.store, args.history, sys.stdin.read() if args.stdin else None, analyzer, args.update, args.projects, None if args.yes else choose, say=tell).code


if __name__ == "__main__":
    sys.exit(main())
