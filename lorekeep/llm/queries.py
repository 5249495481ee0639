"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, hamming, langid, mixing, simhash, suffix, tokencount, toolcalls, toxicity
from .common import crc_mod, small_batches, table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["held_out"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = mixing.quotas(table(spark, sf_dir, "documents"))
    return q.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every message: calls, results that no call takes, system and other roles; rows with a null conversation or turn have no identifier."""
    rows = table(spark, sf_dir, "conversations")
    calls, results = toolcalls.calls_and_results(rows)
    linked = toolcalls.link(calls, results, toolcalls.REPLY, toolcalls.other_messages(rows))
    return linked.select(F.col("conv").alias("conv_id"), "turn", F.col("id").alias("call_id"), "level", "linked", "valid", F.sha2("line", 256).alias("line_sha256"))


def op7_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 20 = 0"), k=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    score = toxicity.score_column(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, threshold=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(found["fp"][0]).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_bpe_round_trip, op2_language_id, op3_token_counts, op4_nearest_neighbours, op5_source_mixing,
    op6_tool_calls, op7_code_search, op8_toxicity, op9_simhash, op10_suffix_dedup,
)}

SQL = {
    "op6_tool_calls": r"""
WITH u AS (SELECT a.conv_id, a.turn, a.text, EXISTS (FROM conversations b WHERE b.role = 'user' AND b.conv_id = a.conv_id AND b.turn = a.turn - 2) AS before FROM conversations a WHERE a.role = 'user'),
calls AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS id, text IS NOT NULL AND turn IS NOT NULL AS valid,
            '{' || concat_ws(',', CASE WHEN before THEN '"after":"call_' || conv_id || '_' || (turn - 2) || '"' END, '"text":' || to_json(text), '"turn":' || turn) || '}' AS args FROM u),
r AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS id, text,
        CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) END AS nth
      FROM conversations WHERE role = 'assistant'),
chain AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, turn // 2 - n ORDER BY turn) - 1 AS level FROM (
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM calls WHERE id IS NOT NULL)))
SELECT c.conv_id, c.turn, c.id AS call_id, l.level::INTEGER AS level, r.id IS NOT NULL AS linked, c.valid,
  sha256('{' || concat_ws(',', '"arguments":' || to_json(c.args), '"content":' || to_json(r.text), '"id":"' || c.id || '"', '"name":"reply","role":"assistant"') || '}') AS line_sha256
FROM calls c LEFT JOIN chain l ON l.conv_id = c.conv_id AND l.turn = c.turn LEFT JOIN r ON r.conv_id = c.conv_id AND r.id = c.id AND r.nth = 1
UNION ALL
SELECT r.conv_id, r.turn, r.id, NULL, false, false, sha256('{' || concat_ws(',', '"content":' || to_json(text), '"id":"' || r.id || '"', '"role":"tool"') || '}')
FROM r WHERE nth > 1 OR NOT EXISTS (FROM calls c WHERE c.conv_id = r.conv_id AND c.id = r.id)
UNION ALL
SELECT conv_id, turn, NULL, NULL, false, false, sha256('{' || concat_ws(',', '"content":' || to_json(text), '"role":' || to_json(role)) || '}')
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
""",
    "op7_code_search": r"""
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda c: CASE WHEN c > 0 THEN '1' ELSE '0' END) AS bits FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL)) = 0),
packed AS (SELECT vec_id, array_to_string(bits, '')::BIT AS code FROM codes),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM packed q JOIN packed c ON q.vec_id <> c.vec_id AND length(q.code) = length(c.code) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance FROM d
QUALIFY rank <= 10
""",
}
