"""From documents to token digests: quality, lines, near copies, mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelink.llm import bpe, line_dedup, mixing, near_dup, quality
from placelink.llm.common import drop, table

#: Rows up to which a table of ids is broadcast: some 2 MB.
BROADCAST_ROWS = 100_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on ``labels``, rejects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=True).where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that spread over sites; ``n_chars`` follows the text."""
    clean = line_dedup.remove(docs).drop("_lines")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies.

    Five-word shingles, similarity 0.8.  Rows that share an id count as one
    document, of which the row with the least text stays; rows without an id
    link with nothing and stay.
    """
    found = near_dup.join(docs, n=5, percent=80)
    gone = table(found.where("id <> component").select(F.col("id").alias("doc_id")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = table(found.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("doc_id")), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    first = Window.partitionBy("doc_id").orderBy("text")
    again = kept.join(twice, "doc_id", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).union(again.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the source mix does, in order of training position."""
    return mixing.schedule(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix takes."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", boilerplate),
    ("near_dedup", near_copies),
    ("source_mix", mix),
    ("byte_bpe", tokens),
]

#: The classifier cannot be expressed in SQL; tests compare the rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written for the next, and goes when that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
