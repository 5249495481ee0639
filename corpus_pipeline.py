"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the
shared folder and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, jaccard, mixing, suffix, toxicity
from lorekeep.llm.common import cut, numbered, small_batches, table

#: No stage sequence with a model, fingerprints or a tokenizer can be expressed in SQL; tests hold it against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below toxicity.THRESHOLD, by a model of all labelled documents. Null and empty texts have the bias's score. Without labelled documents all stay."""
    labels = table(spark, sf_dir, "labels")
    if not toxicity.labelled_rows(docs, labels, modulus=None).limit(1).count():
        return docs
    score = toxicity.score_column(docs, labels, modulus=None)
    return small_batches(docs).where(score < toxicity.THRESHOLD)


#: Words of a shingle.
NEAR = 5


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked at a Jaccard similarity of 0.8 of their five-word shingles, the document of smallest doc_id (one row of it) stays. Null and empty texts are one group."""
    src, own = numbered(docs)
    marked = small_batches(src).select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("id"), jaccard.signatures(F.col("text"), NEAR).alias("s")).select("row", "id", "s.*")
    # a group of any size is reduced where its rows lie: first by shingle set, then by component; null ids come last
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "fp", "keys", "sketch")).alias("first")
    nodes = cut(cut(marked, "marked").groupBy("whole").agg(least).select("first.*").withColumnRenamed("row", "node"), "nodes")
    group = jaccard.groups(nodes.select("node", "fp", "keys", "sketch"), src.select(F.col(own).alias("node"), "text"), NEAR)
    kept = nodes.join(group, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min(F.struct("last", "id", "node")).alias("first")).select(F.col("first.node").alias(own))
    return src.join(kept, own, "left_semi").drop(own)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a 200-byte passage that occurs elsewhere; a split character goes whole. A document of which nothing stays goes too; n_chars follows the text."""
    keep = suffix.with_kept_text(docs, suffix.LENGTH)
    return keep.where("_n_removed = 0 OR length(text) > 0").withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document comes as often as the mix takes it, a last copy cut to the words taken."""
    return mixing.apply(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each remaining text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
