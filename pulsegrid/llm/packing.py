"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, the longest first: as many full
sequences as fit, then the binary digits of the rest. Each piece is a sequence of its own, stored in
the bucket of its length, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.codes import encoder, small_batches
from pulsegrid.llm.token_files import with_end

PIECES = "doc_id long, part int, number long, start long, doc_tokens long, length int, ids array<int>"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long"


def cut(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and length of every piece of documents of these lengths, in order."""
    full = lengths // longest
    powers = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    digits = (lengths % longest)[:, None] & powers[None, :]
    table = np.concatenate([full[:, None], digits > 0], axis=1)
    sizes = np.broadcast_to(np.concatenate([[longest], powers]), table.shape)
    repeats = table.ravel()
    owners = np.repeat(np.arange(len(lengths)), table.sum(axis=1))
    return owners, np.repeat(sizes.ravel(), repeats)


def pieces(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces with their ids of ``docs`` (doc_id, text, any others).

    Null and empty texts are just the end id. Repeated rows and rows without a doc_id are packed like
    any other. ``number`` counts a task's pieces of one length; ``part`` is that task's partition.
    """
    if longest < 2 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches):
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), np.int64)
        for batch in small_batches(batches):
            ids, bounds = code.encode(batch.column(1).to_pylist())
            flat, begins, totals = with_end(ids, bounds, end_id)
            owners, sizes = cut(totals, longest)
            ends = np.cumsum(sizes)
            level = np.log2(sizes).astype(np.int64)
            number = np.empty(len(sizes), np.int64)
            for k in np.unique(level):
                own = level == k
                number[own] = seen[k] + np.arange(own.sum())
                seen[k] += own.sum()
            columns = [
                batch.column(0).take(pa.array(owners)),
                pa.array(np.full(len(sizes), part, np.int32)),
                pa.array(number),
                pa.array(ends - sizes - begins[owners]),
                pa.array(totals[owners]),
                pa.array(sizes.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat)),
            ]
            names = ["doc_id", "part", "number", "start", "doc_tokens", "length", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, PIECES)


def write_buckets(found: DataFrame, folder: str) -> None:
    """Store pieces as one folder per length."""
    found.write.partitionBy("length").option("parquet.page.size", str(64 << 10)).parquet(folder)


def sequence_offsets(stored: DataFrame) -> DataFrame:
    """Rows (length, part, first): sequences are numbered bucket by bucket, longest first.

    The windows hold one row per task and length, and one per length.
    """
    counts = stored.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("length").agg(F.sum("_n").alias("_n"))
    heads = sizes.select("length", F.coalesce(F.sum("_n").over(longer), F.lit(0)).alias("_head"))
    inside = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in"))
    return inside.join(heads, "length").select("length", "part", (F.col("_head") + F.col("_in")).alias("first"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """What the buckets hold, one row per piece."""

    def run(batches):
        for batch in batches:
            lists = batch.column(6)
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = lists.offsets.to_numpy()
            found = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            doc, part, number, start, total, length = batch.columns[:6]
            columns = [doc, start, length.cast(pa.int64()), pa.array(found, pa.int64()), total, part, number]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "part", "number", "start", "doc_tokens", "length", "ids"]
    stored = spark.read.schema(PIECES).parquet(folder).select(*names)
    offsets = sequence_offsets(stored.select("length", "part"))
    return (
        stored.mapInArrow(run, DIGEST)
        .join(offsets, ["length", "part"])
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("first") + F.col("number")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
