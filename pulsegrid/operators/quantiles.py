"""Exact percentiles of whole numbers per group, from a mergeable sketch and counting passes.

A sketch of bounded size per group, combined before the shuffle, says between which two values a place in
the sorted order surely lies, nearly. A counting pass then counts what lies below, and the rest in at most
``CUTS`` equal spans between the two values. It shows whether the sketch was right, and names the span
that holds the place; the next pass looks into that span alone. A place is found when its span is one
value. No pass sorts or keeps the values of a group, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pulsegrid.session import drop_folder, fresh_folder

#: Size of a sketch.
SKETCH = 1024
#: Share of the ranks on either side of a place that its first span covers, three times the usual error.
MARGIN = 0.01
CUTS = 64


def null_safe_join(left: DataFrame, right: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Join on the group columns in which NULLs meet; the columns of ``left`` stay."""
    renamed = right.withColumnsRenamed({g: f"_right_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"_right_{g}")) for g in groups]
    return left.join(renamed, on, how).drop(*[f"_right_{g}" for g in groups])


def summary(rows: DataFrame, value: str, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group: ``n, mean, <shares>, lowest, highest`` of a whole-number column; NULL groups count.

    ``shares`` names percentiles, as in ``{"p95": 0.95}``; they interpolate linearly between two places.
    Rows without a value are left out. The two columns are written to the shared folder, so that what
    makes them runs once; they go when all places are found.
    """
    spark = rows.sparkSession
    values = fresh_folder(spark, "values")
    rows.select(*groups, F.col(value).cast("long").alias("_v")).where("_v IS NOT NULL").write.parquet(values)
    stored = spark.read.parquet(values)
    known = fresh_folder(spark, "sketches")
    stored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("_v").cast("decimal(38,0)")).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.min("_v").alias("lowest"),
        F.max("_v").alias("highest"),
        F.kll_sketch_agg_bigint("_v", F.lit(SKETCH)).alias("_sketch"),
    ).write.parquet(known)
    totals = spark.read.parquet(known)
    found = _places(stored, totals, groups, list(shares.values()))
    drop_folder(spark, values)
    at = [F.max(F.when(F.col("_which") == i, F.col("_lo"))).alias(f"_at_{i}") for i in range(2 * len(shares))]
    listed = found.groupBy(*groups).agg(*at)
    whole = null_safe_join(totals, listed, groups)
    named = {}
    for i, (name, share) in enumerate(shares.items()):
        low, high, exact = F.col(f"_at_{2 * i}"), F.col(f"_at_{2 * i + 1}"), F.lit(share) * (F.col("n") - 1)
        named[name] = low + (high - low) * (exact - F.floor(exact))
    return whole.select(*groups, "n", "mean", *[c.alias(n) for n, c in named.items()], "lowest", "highest")


def _places(stored: DataFrame, totals: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """The values at the two places of every share: rows (groups, _which, _lo)."""
    spark = stored.sparkSession
    spans = []
    for share in shares:
        bounds = [F.lit(max(0.0, share - MARGIN)), F.lit(min(1.0, share + MARGIN))]
        low, high = (F.kll_sketch_get_quantile_bigint("_sketch", b) for b in bounds)
        for rounding in (F.floor, F.ceil):
            span = (
                F.lit(len(spans)).alias("_which"),
                rounding(F.lit(share) * (F.col("n") - 1)).cast("long").alias("_place"),
                # in a small group the margin is no place wide
                F.when(F.col("n") < 2 / MARGIN, F.col("lowest")).otherwise(low).alias("_lo"),
                F.when(F.col("n") < 2 / MARGIN, F.col("highest")).otherwise(high).alias("_hi"),
            )
            spans.append(F.struct(*span))
    spans = totals.select(*groups, "lowest", "highest", F.inline(F.array(*spans)))
    spans = _narrowed(stored, spans, groups)
    while True:
        folder, seen = fresh_folder(spark, "places"), Observation()
        spans.observe(seen, F.count_if(~F.col("_sure")).alias("open")).write.parquet(folder)
        state = spark.read.parquet(folder)
        if not seen.get["open"]:
            return state.select(*groups, "_which", "_lo")
        spans = state.where("_sure").unionByName(_narrowed(stored, state.where("NOT _sure"), groups))


def _narrowed(stored: DataFrame, state: DataFrame, groups: list[str]) -> DataFrame:
    """One counting pass: each place with the narrower span that it lies in."""
    # spans wider than half of all whole numbers are counted in halves of the values
    near_zero = f"_lo >= {-(1 << 62)} AND _hi < {1 << 62}"
    cut = F.expr(
        f"""CASE WHEN _v < _lo THEN -1 WHEN {near_zero} THEN (_v - _lo) div ((_hi - _lo) div {CUTS} + 1)
            ELSE (_v div 2 - _lo div 2) div ((_hi div 2 - _lo div 2) div {CUTS} + 1) END"""
    )
    place = [*groups, "_which"]
    near = null_safe_join(stored, state.select(*place, "_place", "_lo", "_hi"), groups).where("_v <= _hi")
    counts = near.select(*place, "_place", cut.alias("_cut"), "_v").groupBy(*place, "_place", "_cut")
    counts = counts.agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    # at most CUTS + 1 rows of a place
    upto = F.sum("_n").over(Window.partitionBy(*place).orderBy("_cut"))
    holding = counts.withColumn("_upto", upto).where("_upto > _place AND _upto - _n <= _place")
    return null_safe_join(state, holding.select(*place, "_cut", "_first", "_last"), place, "left").select(
        *groups, "lowest", "highest", "_which", "_place",
        # a span that does not hold the place lies on its wrong side
        F.expr("CASE WHEN _cut IS NULL THEN _hi + 1 WHEN _cut = -1 THEN lowest ELSE _first END").alias("_lo"),
        F.expr("CASE WHEN _cut IS NULL THEN highest WHEN _cut = -1 THEN _lo - 1 ELSE _last END").alias("_hi"),
        F.expr("coalesce(_cut >= 0 AND _first = _last, false)").alias("_sure"),
    )
