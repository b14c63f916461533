"""Running values within ordered groups, exact also when one group holds most of the rows.

A window over a group runs in one task. That is fine for ordinary groups and fatal for a group with a
third of all rows. Every group is therefore cut into slices, and the slice is a function of the row: the
span of time its first order column falls into. Windows run per group and slice. What a slice needs to
know of the slices before it is one small row per slice; these rows are scanned per group and joined back.
All groups take the same plan, whatever their sizes.

The rows are shuffled once, by group and slice. Slice ends and windows both read that shuffle: every reader
asks for all columns, so that Spark finds the shuffles equal and runs what made the rows only once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a slice. Shorter ones cut a hot group finer and make more slice rows of sparse groups.
SLICE_SECONDS = 3600
SLICE = "_slice"
BEFORE_ALL = -(1 << 62)


@dataclass(frozen=True)
class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order`` within a group; see ``ordered_groups``."""

    keys: list[str]
    order: list[str]
    df: DataFrame

    def last_before(self, **values: Column) -> OrderedGroups:
        """Add columns: the last non-NULL value strictly before the row, within its group."""
        groups = [*self.keys, SLICE]
        before = Window.partitionBy(*groups).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        local = self.df.select("*", *[F.last(v, ignorenulls=True).over(before).alias(n) for n, v in values.items()])
        place = [F.col(c) for c in self.order]
        newest = {n: F.max(F.when(v.isNotNull(), F.struct(*place, v.alias("v"))))["v"] for n, v in values.items()}
        ends = self.df.groupBy(*groups).agg(*[v.alias(n) for n, v in newest.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        names = {n: f"_in_{n}" for n in values}
        carried = ends.select(*groups, *[F.last(n, ignorenulls=True).over(earlier).alias(c) for n, c in names.items()])
        joined = local.join(carried, groups, "left")
        found = [F.coalesce(n, c).alias(n) for n, c in names.items()]
        return replace(self, df=joined.select(*self.df.columns, *found))

    def with_columns(self, **columns: Column) -> OrderedGroups:
        return replace(self, df=self.df.withColumns(columns))

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE)


def ordered_groups(df: DataFrame, keys: list[str], order: list[str], slice_seconds: int = SLICE_SECONDS) -> OrderedGroups:
    """Prepare running values over groups of ``df``.

    ``keys`` must not be NULL, and ``order`` should be a total order within a group. Its first column is
    a timestamp; NULL comes first, in a slice of its own.
    """
    span = F.floor(F.unix_seconds(order[0]) / slice_seconds).cast("long")
    sliced = df.withColumn(SLICE, F.coalesce(span, F.lit(BEFORE_ALL)))
    return OrderedGroups(keys, order, together(sliced.repartition(*keys, SLICE)))


def together(df: DataFrame) -> DataFrame:
    """The same rows; no reader of ``df`` lets Spark leave columns out of what lies below.

    The condition is always true and ends at its first part; that part is not a function of the row, so
    the condition stays where it is, above the shuffle.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    others = [F.col(f.name).isNull() for f in df.schema if f.name not in hashable]
    named = F.hash(*hashable) == 0
    for other in others:
        named = named | other
    return df.where((F.spark_partition_id() >= 0) | named)
