"""Registered queries of the operators: each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import (
    chat, counts, mixing, one_bit, packing, periodic_runs, projections, quality, ranked_search, shingle_join,
    token_files, toxic_spans, windows,
)
from pulsegrid.session import fresh_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    stored = fresh_folder(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, folder, "documents"), stored, path, end_id=2)
    return token_files.digest(spark, stored)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    stored = fresh_folder(spark, "features")
    quality.feature_rows(table(spark, folder, "documents")).write.parquet(stored)
    rows = spark.read.parquet(stored)
    found = quality.scored(rows, quality.train(rows, table(spark, folder, "labels")))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", predicted)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    stored = fresh_folder(spark, "sizes")
    docs = mixing.with_size(table(spark, folder, "documents"))
    docs.select("doc_id", "source", "size").write.parquet(stored)
    mixed = mixing.mix(spark.read.parquet(stored))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op4_projections(spark: SparkSession, folder: str) -> DataFrame:
    return projections.near_duplicates(table(spark, folder, "embeddings"), cosine=0.95)


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_calls(*chat.turns_as_calls(table(spark, folder, "conversations")), chat.ANSWER)


def op6_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.cleaned(table(spark, folder, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    found = shingle_join.similar_groups(table(spark, folder, "documents"), n=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_one_bit(spark: SparkSession, folder: str) -> DataFrame:
    return one_bit.search(one_bit.index(table(spark, folder, "embeddings")), every=20, k=20)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    stored = fresh_folder(spark, "packed")
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing.write_buckets(packing.pieces(table(spark, folder, "documents"), path), stored)
    return packing.digest(spark, stored)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    stored = fresh_folder(spark, "items")
    ranked_search.item_terms(table(spark, folder, "benchmark")).write.parquet(stored)
    asked = spark.read.parquet(stored)
    return ranked_search.search(ranked_search.build_index(table(spark, folder, "documents"), asked), asked, k=10)


def op12_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxic_spans.toxic_spans(docs, toxic_spans.train(docs, table(spark, folder, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", toxic_spans.held_out().alias("held_out"), "score", predicted, "spans")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_repeats(table(spark, folder, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_projections": op4_projections,
    "op5_chat": op5_chat,
    "op6_windows": op6_windows,
    "op7_shingle_join": op7_shingle_join,
    "op8_one_bit": op8_one_bit,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_toxic_spans": op12_toxic_spans,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op3_mixing": mixing.ORACLE,
    "op4_projections": projections.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
}
