"""First-wins storing of readings: what to write, what is there already, what came of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ordered_groups import together
from pulsegrid.schemas import TELEMETRY

KEY = list(TELEMETRY.key)
ARRIVAL = ["partition", "offset"]
STORED = [*KEY, "temperature", "battery", "extra_data"]


#: Bits of a whole number of each type in a packed place, and what is added to make it positive.
PACKED_BITS = {"int": (32, 1 << 31), "bigint": (64, 1 << 63), "timestamp": (60, 1 << 59)}


def packed(rows: DataFrame, columns: list[str]) -> Column | None:
    """The columns, most significant first, as one number that orders like them; NULL where one is NULL.

    A number can be compared and kept by a hash aggregation, a struct cannot. None where the columns are
    of other types or too wide for 38 digits.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in columns]
    if any(k not in PACKED_BITS for k in kinds) or sum(PACKED_BITS[k][0] for k in kinds) > 126:
        return None
    place = F.lit(0).cast("decimal(38,0)")
    for name, kind in zip(columns, kinds, strict=True):
        bits, shift = PACKED_BITS[kind]
        number = F.unix_micros(name) if kind == "timestamp" else F.col(name)
        scaled = (place * _whole(1 << bits)).cast("decimal(38,0)")
        place = (scaled + number.cast("decimal(20,0)") + _whole(shift)).cast("decimal(38,0)")
    return place


def _whole(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(20,0)")


#: Bits by which rows of one place are told apart, where the place leaves room for them.
CONTENT_BITS = 30


def _winners(rows: DataFrame, key: list[str], order: list[str], pick: Callable[[str], Column]) -> DataFrame:
    """The row of the picked place of each key, in two steps.

    The places are aggregated by hash, combined before the shuffle; then the rows are matched with the
    picked places. Rows are spread by place, so copies of one key never meet in one task. The hash of
    the key guards against two keys with the same place, and of several rows of one key at one place
    the hash of their content picks one.
    """
    place, plain = packed(rows, order), [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    if sum(PACKED_BITS[rows.schema[c].dataType.simpleString()][0] for c in order) + CONTENT_BITS <= 126:
        content = F.pmod(F.xxhash64(*plain), F.lit(1 << CONTENT_BITS)).cast("decimal(20,0)")
        place = ((place * _whole(1 << CONTENT_BITS)).cast("decimal(38,0)") + content).cast("decimal(38,0)")
    names = {"_place": place, "_hash": F.xxhash64(*key)}
    spread = together(rows.withColumns(names).repartition(*names))
    picked = spread.groupBy(*key).agg(pick("_place").alias("_place"))
    picked = picked.select("_place", F.xxhash64(*key).alias("_hash"))
    # one place per key is no small table, however small Spark expects what was parsed to be
    found = spread.join(picked.hint("merge"), list(names), "left_semi")
    if len(plain) == len(rows.columns):
        found = found.distinct()  # whole copies lie in one partition already
    return found.select(*rows.columns)


def dedupe_first_wins(
    rows: DataFrame, key: list[str] | None = None, arrival: list[str] | None = None
) -> DataFrame:
    """One row per key: the first to arrive.

    ``arrival`` orders the rows of a key and is never NULL. Where its columns fit into one number,
    this is a hash aggregation and a semi join; else the whole rows are aggregated by sorting.
    Either way copies are combined before the shuffle of keys.
    """
    key, arrival = key or KEY, arrival or ARRIVAL
    if packed(rows, arrival) is not None:
        return _winners(rows, key, arrival, F.min)
    return _picked_rows(rows, key, F.min_by, [F.col(c) for c in arrival])


def _picked_rows(rows: DataFrame, key: list[str], pick: Callable[[Column, Column], Column], order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    picked = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    found = rows.groupBy(*key).agg(picked)
    return found.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def anti_join_existing(
    rows: DataFrame, stored: DataFrame, key: list[str] | None = None
) -> DataFrame:
    """Rows whose key is not stored yet. ``rows`` should be free of copies.

    Both sides are shuffled by key: what is stored grows without end and is never sent to every executor.
    """
    key = key or KEY
    return rows.join(stored.select(*key).hint("merge"), key, "left_anti")


def with_date(rows: DataFrame, time: str = "time") -> DataFrame:
    """Add the partition column ``dt``."""
    return rows.withColumn("dt", F.to_date(time))


def quarantine_split(
    readings: DataFrame, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows fit to be stored, and rows that would break a write (a NULL in the key or error)."""
    key = key or KEY
    broken = F.lit(False)
    for name in key:
        broken = broken | F.col(name).isNull()
    reason = F.coalesce("error", F.when(broken, F.lit("Unstorable: NULL key")))
    tagged = readings.withColumn("error", reason)
    return tagged.where(F.col("error").isNull()), tagged.where(F.col("error").isNotNull())


def write_stats(
    offered: DataFrame, stored: DataFrame, batch: str = "batch_id", key: list[str] | None = None
) -> DataFrame:
    """Rows offered, written and duplicate per batch, batches being stored one after the other.

    A key is written by the earliest batch that offers it, unless it is stored already.
    """
    key = key or KEY
    per_key = offered.groupBy(*key).agg(F.min(batch).alias(batch))
    written = anti_join_existing(per_key, stored, key).groupBy(batch).agg(
        F.count("*").alias("written")
    )
    sizes = offered.groupBy(batch).agg(F.count("*").alias("offered"))
    count = F.coalesce("written", F.lit(0).cast("bigint"))
    return sizes.join(written, batch, "left").select(
        batch, "offered", count.alias("written"), (F.col("offered") - count).alias("duplicates")
    )


def touched(stored: DataFrame, rows: DataFrame, dates: list | None, column: str = "dt") -> DataFrame:
    """Stored rows of the dates that ``rows`` touch: by list where given, else by a semi join."""
    if dates is not None:
        return stored.where(F.col(column).isin(dates))
    return stored.join(rows.select(column).distinct(), column, "left_semi")


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. ``order`` orders the rows of a key totally; see ``dedupe_first_wins``."""
    if packed(rows, order) is not None:
        return _winners(rows, key, order, F.max)
    return _picked_rows(rows, key, F.max_by, [F.col(c) for c in order])
