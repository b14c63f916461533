"""Embedding near-duplicates by counting collisions on sorted projections.

Every vector is projected on many random lines; each line comes with a few random signs, so that only
vectors on the same side of a few planes are neighbours on it. Around every vector a window is laid on
every line, and the lines on which a pair falls into one window are counted. Pairs with at least
``NEEDED`` of them are compared exactly. The number of signs follows the number of vectors, which keeps
windows short; the number of lines then follows from the recall wanted at the threshold.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import components
from pulsegrid.llm.vectors import usable
from pulsegrid.session import fresh_folder

#: Lines a pair must share a window on before it is compared.
NEEDED = 2
#: Half a window, in standard deviations of the distance on a line of a pair at the threshold.
REACH = 2.0
#: Vectors a cell of the signs holds on average.
CELL = 16


def plan(vectors: int, cosine: float, recall: float) -> tuple[int, int]:
    """Signs per line and number of lines for a recall at the threshold."""
    signs = max(0, math.ceil(math.log2(max(vectors, 1) / CELL)))
    inside = math.erf(REACH / math.sqrt(2))
    meet = (1 - math.acos(cosine) / math.pi) ** signs * inside
    lines = NEEDED
    while sum(math.comb(lines, i) * meet**i * (1 - meet) ** (lines - i) for i in range(NEEDED)) > 1 - recall:
        lines += 1
    return signs, lines


@lru_cache(maxsize=8)
def directions(size: int, signs: int, lines: int) -> np.ndarray:
    """Random directions: of each line its own, then those of its signs."""
    return np.random.default_rng([7, size, signs, lines]).standard_normal((size, lines * (signs + 1)))


def _entries(classes: DataFrame, signs: int, lines: int, half: float) -> DataFrame:
    """Rows (line, cell, slot, value, node): where every vector lies on every line.

    A slot is one half window long, so a window reaches into the neighbouring slots only.
    """

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            at = np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                rows = flat[at[own][:, None] + np.arange(size)]
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                found = (rows @ directions(int(size), signs, lines)).reshape(len(own), lines, signs + 1)
                bits = (found[:, :, 1:] > 0) @ (1 << np.arange(signs, dtype=np.int64))
                cell = bits * 65_537 + size
                value = found[:, :, 0]
                line = np.broadcast_to(np.arange(lines, dtype=np.int32), value.shape)
                node = np.repeat(batch.column(0).to_numpy()[own], lines)
                columns = [line.ravel(), cell.ravel(), np.floor(value / half).astype(np.int64).ravel(), value.ravel(), node]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["line", "cell", "slot", "value", "node"])

    return classes.select("node", "embedding").mapInArrow(run, "line int, cell long, slot long, value double, node long")


def _verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Pairs whose cosine, in double precision, is at least ``cosine``."""

    def run(batches):
        for batch in batches:
            sides = []
            for i in (2, 3):
                lists = batch.column(i)
                sides.append(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
            starts = np.append(0, np.cumsum(np.diff(batch.column(2).offsets.to_numpy())))[:-1]
            x, y = sides
            if len(starts):
                sums = [np.add.reduceat(v, starts) for v in (x * y, x * x, y * y)]
                keep = sums[0] >= cosine * np.sqrt(sums[1]) * np.sqrt(sums[2])
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    sides = classes.select("node", "embedding")
    one, two = (sides.select(F.col("node").alias(s), F.col("embedding").alias(f"_{s}")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _stored(frame: DataFrame, name: str) -> DataFrame:
    folder = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors`` (vec_id, embedding, any others).

    Links are pairs of rows with cosine at least ``cosine``; a pair at the threshold itself is found with
    probability ``recall``, nearer ones more surely. Equal vectors are one node and always linked.
    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. A row without a vec_id gives no component its name. Repeated rows are links
    of each other; all rows of the smallest vec_id are kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("_ok", usable("embedding"))
    grouped = rows.filter("_ok").groupBy("embedding").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
    classes = _stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    half = REACH * math.sqrt(2 - 2 * cosine)
    signs, lines = plan(classes.count(), cosine, recall)
    entries = _stored(_entries(classes, signs, lines, half), "entries")
    names = ["line", "cell", "slot"]
    one = entries.select(*names, F.col("value").alias("value_a"), F.col("node").alias("node_a"))
    beside = F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot")
    two = entries.select("line", "cell", beside, F.col("slot").alias("_own"), F.col("value").alias("value_b"), F.col("node").alias("node_b"))
    met = one.join(two, names).filter((F.col("_own") > F.col("slot")) | (F.col("node_a") < F.col("node_b")))
    met = met.filter(F.abs(F.col("value_a") - F.col("value_b")) <= half)
    pairs = met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") >= min(NEEDED, lines)).select("a", "b")
    links = _stored(_verified(pairs, classes, cosine), "links")
    ends = links.union(links.select(F.col("b"), F.col("a")))
    sizes = classes.select(F.col("node").alias("b"), F.col("size").alias("_other"))
    degrees = ends.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("_other").alias("_others"))
    named = classes.join(components(links), "node", "left").join(degrees, "node", "left")
    named = named.withColumn("_group", F.coalesce("component", "node"))
    names = named.groupBy("_group").agg(F.min("least").alias("component_id"))
    found = named.join(names, "_group").select(
        F.col("embedding").alias("_embedding"),
        (F.col("size") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"),
        "component_id",
    )
    alone = rows.filter("NOT _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.filter("_ok").join(found, F.col("embedding") == F.col("_embedding")).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Exact pairs in SQL.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
