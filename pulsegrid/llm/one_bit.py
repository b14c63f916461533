"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors are centred, padded to ``bits`` dimensions and rotated; a code keeps the signs, packed, with
two correction scalars: the length of the centred vector, and how well its direction agrees with its
code. Codes give an estimate of an inner product and a bound of its error. In a block of rows, rows
whose upper bound reaches the k-th best lower bound are ranked again on the vectors themselves.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.vectors import usable
from pulsegrid.session import fresh_folder

#: Width of the error bounds, in the deviations that a random rotation gives.
BOUND = 3.0
QUERY_BLOCK = 2048
ROW_BLOCK = 8192


@lru_cache(maxsize=8)
def rotation(size: int, bits: int) -> np.ndarray:
    """The first ``size`` rows of a random orthogonal matrix of ``bits`` dimensions."""
    basis, signs = np.linalg.qr(np.random.default_rng([11, size, bits]).standard_normal((bits, size)))
    return (basis * np.sign(np.diag(signs))).T


def encode(rows: np.ndarray, centre: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths of the centred rows, and their agreement with the codes."""
    rest = rows - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-300)[:, None]) @ rotation(rows.shape[1], bits)
    agree = np.abs(turned).sum(axis=1) / math.sqrt(bits)
    return np.packbits(turned > 0, axis=1), length, np.maximum(agree, 1e-12)


def estimates(queries: np.ndarray, centre: np.ndarray, codes, length, agree, bits: int):
    """Estimated inner products of queries and coded rows, and the bounds of their errors."""
    turned = (queries @ rotation(queries.shape[1], bits)).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    along = (turned @ signs.T) / math.sqrt(bits)
    found = (queries @ centre)[:, None] + along * (length / agree)[None, :]
    spread = length * np.sqrt(np.maximum(0, 1 - agree**2)) / agree / math.sqrt(max(bits - 1, 1))
    return found, BOUND * np.linalg.norm(queries, axis=1)[:, None] * spread[None, :] + 1e-6


INDEX = "vec_id long, size int, embedding array<double>, code binary, length double, agree double"


def index(vectors: DataFrame, bits: int = 256) -> DataFrame:
    """Codes of every usable row of ``vectors`` (vec_id, embedding, any others), stored in the shared folder.

    Centres are means over all rows, one per vector length; they come to the driver as one row each.
    ``bits`` is raised to a length that is longer.
    """
    rows = vectors.filter(usable("embedding")).filter("vec_id IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("size", F.size("embedding"))
    centres = _centres(rows)

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                table = flat[at[own][:, None] + np.arange(size)]
                codes, length, agree = encode(table, centres[int(size)], max(bits, int(size)))
                part = batch.take(pa.array(own))
                columns = [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(agree)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "size", "embedding", "code", "length", "agree"])

    coded = rows.select("vec_id", "size", "embedding").mapInArrow(run, INDEX)
    folder = fresh_folder(vectors.sparkSession, "codes")
    coded.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    return vectors.sparkSession.read.parquet(folder)


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of every vector length."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                total = flat[at[own][:, None] + np.arange(size)].sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * int(size), pa.int32()), pa.array(np.arange(size)), pa.array(total), pa.array([len(own)] * int(size))],
                    ["size", "place", "total", "n"],
                )

    sums = rows.select("size", "embedding").mapInArrow(run, "size int, place long, total double, n long")
    means = sums.groupBy("size", "place").agg((F.sum("total") / F.sum("n")).alias("mean")).toPandas()
    return {int(s): g.sort_values("place")["mean"].to_numpy() for s, g in means.groupby("size")}


NEAREST = "row long, query_id long, vec_id long, score double"


def search(coded: DataFrame, every: int = 20, k: int = 20, bits: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest rows of every row whose vec_id is divisible by ``every``.

    ``coded`` comes from ``index``. All rows but the query's own are candidates; rows without a vec_id
    and unusable vectors take no part; vectors of other lengths are no candidates. Nearest first, ties
    to the smaller vec_id. Queries and rows meet in blocks, of which every pair is one group.
    """
    centres = _centres(coded.select("size", "embedding"))
    queries = coded.filter(F.col("vec_id") % every == 0)
    row_blocks = max(1, math.ceil(coded.count() / ROW_BLOCK))
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    deal = F.xxhash64("row")
    rows = coded.withColumn("rows", F.pmod(deal, F.lit(row_blocks))).withColumn(
        "queries", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>"))
    )
    # names of their own: the two sides come from one table, and Spark prunes columns by identity
    asked = queries.withColumn("q_queries", F.pmod(deal, F.lit(query_blocks))).select(
        "q_queries", *[F.col(c).alias(f"q_{c}") for c in ("row", "vec_id", "size", "embedding")]
    )
    asked = asked.withColumn("q_rows", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<long>")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            size = left.column("q_size")[0].as_py()
            pair = (left.column("q_embedding"), right.column("embedding"))
            q, x = (c.combine_chunks().flatten().to_numpy().reshape(-1, size) for c in pair)
            raw = b"".join(right.column("code").to_pylist())
            codes = np.frombuffer(raw, np.uint8).reshape(len(x), -1)
            length, agree = (right.column(c).to_numpy() for c in ("length", "agree"))
            ids, own = right.column("vec_id").to_numpy(), right.column("row").to_numpy()
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                guess, error = estimates(some, centres[size], codes, length, agree, max(bits, size))
                me = left.column("q_row").to_numpy()[at : at + 256]
                guess[me[:, None] == own[None, :]] = -np.inf
                low = guess - error
                place = max(0, low.shape[1] - k)
                reached = np.partition(low, place, axis=1)[:, place]
                near = guess + error >= reached[:, None]
                near &= me[:, None] != own[None, :]
                names = left.column("q_vec_id").to_numpy()[at : at + 256]
                for i in range(len(some)):
                    hits = np.flatnonzero(near[i])
                    # a matrix product rounds by row position; equal vectors need equal scores, to the last bit
                    score = (x[hits] * some[i]).sum(axis=1)
                    order = np.lexsort((ids[hits], -score))[:k]
                    n = len(order)
                    parts.append((np.full(n, me[i]), np.full(n, names[i]), ids[hits][order], score[order]))
        columns = zip(*parts, strict=True) if parts else [[np.empty(0, np.int64)]] * 3 + [[np.empty(0)]]
        return pa.table({n: np.concatenate(c) for n, c in zip(["row", "query_id", "vec_id", "score"], columns, strict=True)})

    keys = ["queries", "rows", "size"]
    found = asked.groupBy(*[f"q_{k}" for k in keys]).cogroup(rows.groupBy(*keys)).applyInArrow(compare, NEAREST)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
