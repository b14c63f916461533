"""Evaluating costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, however often later steps refer to them.

    A filter on a projected column is pushed below the projection with the column's expression
    copied into it, so JSON would be parsed again for every use. Rows made by a generator are
    not taken apart like that; a generator of exactly one row leaves the data as it is.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
