"""Transcripts made from the events table by SQL that Spark and DuckDB both run, so rules have something to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .runtime import ship

#: {p}: the user's project; {n}: a small number; | : a line break.
BANK = [
    "Working on {p} today with Python and FastAPI.", "Project: {p} needs a clear plan for part {n}.",
    "todo write loader number {n}|- fix the parser later maybe", "The export is completed for part {n}.",
    "bug: totals are broken in view {n}|1. reproduce it on a small file", "idea cache results in Redis for {n}",
    "We decided to move from SQLite to PostgreSQL for {p}", "The service must not call the network in step {n}",
    "Which index is better, tree or hash?|Let us measure first", "Done: implemented importer {n} for {p}",
    "надо добавить проверку входных данных {n}", "Решили перейти с Flask на Django в проекте {p}",
    "Сделано: отчёт номер {n} готово", "Нельзя менять формат файла {n}, только локально",
    "Неясно, или сервер или клиент виноват?", "Short", "Docker image {n} builds, git tag pushed|* tests with pytest pass",
    "later we add TypeScript and React pages", "memory_json and test_helper are only file names",
    "constraint: constraint list has {n} rows", "todo fix flaky loader number {n}|todo fix flaky loader number {n} again",
    "ошибка при чтении, не работает импорт {n}", "migrated from Redis to sqlite, previous plan {n} dropped",
    "{p} status: whether part {n} is done?",
]
PROJECTS = ["river_mapper", "grid_sync", "lantern_bot", "pebble_core", "orbit_notes"]


def messages_cte() -> str:
    """CTEs ending in messages(history_id, number, role, date, text); a history has up to 60 messages."""
    bank = ", ".join(f"({i}, '{s}')" for i, s in enumerate(BANK))
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(PROJECTS))
    return f"""bank AS (SELECT * FROM (VALUES {bank}) AS t(k, s)),
names AS (SELECT * FROM (VALUES {names}) AS t(k, p)),
numbered AS (SELECT user_id AS history_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS number FROM events),
messages AS (SELECT n.history_id, n.number, CASE WHEN n.number % 2 = 1 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN n.event_id % 3 = 0 THEN concat('2024-01-', lpad(CAST(n.event_id % 28 + 1 AS STRING), 2, '0')) END AS date,
  replace(replace(replace(b.s, '{{p}}', m.p), '{{n}}', CAST(n.event_id % 5 AS STRING)), '|', chr(10)) AS text
  FROM numbered n JOIN bank b ON b.k = (n.event_id * 7 + n.history_id) % {len(BANK)} JOIN names m ON m.k = n.history_id % {len(PROJECTS)})"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(history_id, number, role, date, text)."""
    ship(spark)
    return spark.sql(f"WITH events AS (SELECT * FROM parquet.`{sf_dir}/events.parquet`), {messages_cte()} SELECT * FROM messages")
