"""Which vectors take part in comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(name: str) -> Column:
    """True for vectors that are not null or zero and hold no null or non-finite component."""
    infinite = F.lit(float("inf"))
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return F.coalesce(F.exists(name, lambda x: x != 0) & ~bad, F.lit(False))
