"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size of the source`` times. Documents of a source
are put in order of size, expected copies are summed along that order, one offset per source is added,
and a document is taken once per whole number its interval crosses. The order makes the words taken
come close to the target; the sums are made over counts, so no task sees a whole source.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Fractions of a copy are whole numbers of this unit, so sums are exact.
UNIT = 1 << 24
KEY = ["source", "_size", "_block"]
RESULTS = ("source_size", "target", "copies")


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    """Add the number of words of ``text`` (null: 0)."""
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Targets of rows (source, source_size), one per source; windows hold one row per source.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes. A target stops at ``most`` times its source; what is left over is shared anew by weight.
    That ends at one level per unit of weight: the largest that any number of stopped sources gives.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("_weight", (F.row_number().over(order) - 1) % 3 + 1)
    rows = rows.withColumn("_cap", F.lit(most) * F.col("source_size"))
    all_rows = Window.partitionBy()
    stops = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    stops = stops.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(stops), F.lit(0))
    weight = F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(stops), F.lit(0))
    rows = rows.withColumn("_left", left.cast("double") / weight)
    level = F.max("_left").over(all_rows)
    return rows.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_weight"))).select(
        "source", "source_size", "target"
    )


def mix(docs: DataFrame, counts: DataFrame | None = None, most: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, source, size, any others) with source_size, target and copies.

    Rows without a source are a source of their own; rows without a doc_id and repeated rows are
    sampled like others; a document of no words may be taken without counting. A rerun takes the same.
    ``counts`` may hold the result of ``group_counts`` if it was stored before. Other columns named
    like a result, or starting with ``_``, are left out.
    """
    names = [c for c in docs.columns if c not in RESULTS and not c.startswith("_")]
    docs = docs.select(*names)
    keyed = _keyed(docs)
    counts = group_counts(docs) if counts is None else counts
    before = Window.unboundedPreceding
    by_size = counts.groupBy("source", "_size").agg(F.sum("_n").alias("_of_size"))
    smaller = Window.partitionBy("source").orderBy("_size").rowsBetween(before, -1)
    sizes = by_size.withColumn("_smaller", F.coalesce(F.sum("_of_size").over(smaller), F.lit(0)))
    earlier = Window.partitionBy("source", "_size").orderBy("_block").rowsBetween(before, -1)
    blocks = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    totals = by_size.groupBy("source").agg(F.sum(F.col("_size") * F.col("_of_size")).alias("source_size"))
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT + 0.5
    sources = source_targets(totals, most).withColumn(
        "_rate", F.least(F.coalesce(F.floor(rate), F.lit(0)).cast("long"), F.lit(most * UNIT))
    )
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")))
    sources = sources.withColumn("_offset", _hex(name, 6))
    places = _joined(_joined(blocks, sizes.drop("_of_size"), ["source", "_size"]), sources, ["source"])
    inside = Window.partitionBy(*KEY).orderBy("doc_id")
    rows = keyed.withColumn("_row", F.row_number().over(inside))
    rows = _joined(rows, places.drop("_n"), KEY)
    rank = F.col("_smaller") + F.col("_earlier") + F.col("_row")
    crossed = [F.shiftright(F.col("_offset") + F.col("_rate") * k, 24) for k in (rank, rank - 1)]
    return rows.withColumn("copies", crossed[0] - crossed[1]).select(*names, "source_size", "target", "copies")


def _keyed(docs: DataFrame) -> DataFrame:
    block = F.coalesce(_hex(F.col("doc_id").cast("string"), 3), F.lit(0))
    return docs.withColumn("_size", F.col("size")).withColumn("_block", block)


def group_counts(docs: DataFrame) -> DataFrame:
    """Documents per (source, size, block): blocks split what one source has of one size."""
    return _keyed(docs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER stops, 0) AS BIGINT) AS DOUBLE)
    / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER stops, 0) AS BIGINT)) AS level
  FROM w
  WINDOW stops AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target,
    ('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 6))::BIGINT AS start
  FROM l
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0
    ELSE least(CAST(floor(target / source_size * {UNIT} + 0.5) AS BIGINT), 3 * {UNIT}) END AS rate FROM t
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size,
    coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 3))::BIGINT, 0), doc_id NULLS FIRST) AS k FROM d
)
SELECT doc_id, size, source_size, target,
  CAST((((start + rate * k) // {UNIT}) - ((start + rate * (k - 1)) // {UNIT})) * size AS BIGINT) AS taken
FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source
"""
