"""Token ids as Parquet list columns that can be read selectively.

The ids of a document are one list in a dictionary-encoded column; ids, bounds and counts of documents
are delta-encoded columns beside it. Files are range-partitioned and sorted by document, with small
row groups and pages, so the page indexes lead a filter on documents to few pages, and metadata is
read without touching a token.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.codes import encoder, small_batches

STORED = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
DIGEST = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"


def encode_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (doc_id, part, part_start, n_tokens, ids) of (doc_id, text) rows, in their order.

    ``part`` is the task's partition and ``part_start`` the ids of that partition before the row.
    """

    def run(batches):
        code, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches):
            ids, bounds = code.encode(batch.column(1).to_pylist())
            flat, at, n = with_end(ids, bounds, end_id)
            starts = pa.array(before + at[:-1])
            before += int(at[-1])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            columns = [batch.column(0), pa.array([part] * len(n), pa.int32()), starts, pa.array(n), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids"])

    return docs.mapInArrow(run, STORED)


def with_end(ids, bounds, end_id):
    """Append ``end_id`` to every text: flat ids, bounds, and lengths."""
    import numpy as np

    count = len(bounds) - 1
    flat = np.insert(ids, bounds[1:], end_id) if count else ids
    at = bounds + np.arange(count + 1)
    return flat.astype(np.int32, copy=False), at, np.diff(at)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 64 << 10,
) -> None:
    """Encode ``docs`` (doc_id, text, any others) and write them to ``folder`` in order of doc_id.

    Null and empty texts are just the end id. Rows without a doc_id come first; rows of equal doc_id
    are all kept, ordered by text. Texts, not ids, are shuffled: they are the smaller of the two.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = encode_rows(rows, tokenizer, end_id).write
    for name, value in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": 1 << 20,
    }.items():
        writer = writer.option(name, str(value))
    writer.parquet(folder)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, part, part_start, n_tokens); the token column is not read."""
    return spark.read.parquet(folder).select("doc_id", "part", "part_start", "n_tokens")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their ids; filters on doc_id use row-group statistics and page indexes."""
    return spark.read.parquet(folder)


def part_offsets(rows: DataFrame, amount) -> DataFrame:
    """Rows (part, offset): what all parts before hold. One row per written part meets in the window."""
    totals = rows.groupBy("part").agg(F.sum(amount).alias("_amount"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("offset"))


def crc_rows(tokens: DataFrame) -> DataFrame:
    """Unsigned crc32 of each document's stored ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = lists.offsets.to_numpy()
            found = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [*batch.columns[:4], pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(run, DIGEST)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold, one row per document: doc_id, start, n_tokens, ids_crc32."""
    offsets = part_offsets(read_metadata(spark, folder), F.col("n_tokens"))
    return (
        crc_rows(read_tokens(spark, folder))
        .join(offsets, "part")
        .select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
    )
