"""Corpus pipeline: every stage reads what the one before it kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, packing, quality, shingle_join, windows
from pulsegrid.session import fresh_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality classifier rejects go. Null texts are scored as empty."""
    stored = fresh_folder(spark, "features")
    quality.feature_rows(docs).write.parquet(stored)
    model = quality.train(spark.read.parquet(stored), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score_column(F.col("text"), model) >= 0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near-duplicates stays."""
    return shingle_join.one_of_each(docs, n=5, percent=75)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages of 200 bytes or more that repeat are cut out; every document stays.

    Characters that a cut splits go as a whole; n_chars follows the text, null texts become empty.
    """
    found = windows.cleaned(docs, length=200).select(F.col("kept_text").alias("text"), "row.*")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document stays as often as the mix takes it."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    taken = mixing.mix(mixing.with_size(rows).drop("text")).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents that are left, packed into sequences."""
    stored = fresh_folder(spark, "packed")
    packing.write_buckets(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), stored)
    return packing.digest(spark, stored)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("suffix-array dedup", unrepeated),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: Tokenizers and trained models cannot be stated in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = fresh_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
