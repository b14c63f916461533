"""Operational analytics over messages, alerts, offsets and metric samples.

Rates are exact counts over half-open windows ``[start, end)`` divided by the window length.
They differ on purpose from counter-sampling systems, which extrapolate to the window edges.
Windows are tumbling by default; a ``slide`` makes them overlap. Overlapping windows are sums of panes as
long as the slide: each message is counted once, in its pane, and only panes go to several windows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ordered_groups import ordered_groups
from pulsegrid.operators.quantiles import null_safe_join
from pulsegrid.operators.parse import error_class

MINUTE = "1 minute"


def _span(text: str) -> timedelta:
    """``5 seconds`` or ``1 hour`` as a time span."""
    number, unit = text.split()
    return timedelta(**{unit.rstrip("s") + "s": int(number)})


def _counts(rows: DataFrame, ts: str, length: str, slide: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """``window``, the ``by`` columns and ``messages`` of each window that has any."""
    messages = F.count(F.lit(1)).alias("messages")
    if slide is None:
        return rows.groupBy(F.window(ts, length).alias("window"), *by).agg(messages)
    if _span(length) % _span(slide):  # panes do not add up to windows
        return rows.groupBy(F.window(ts, length, slide).alias("window"), *by).agg(messages)
    panes = rows.groupBy(F.window(ts, slide).alias("_pane"), *by).agg(messages)
    whole, step = F.expr(f"INTERVAL {length}"), F.expr(f"INTERVAL {slide}")
    starts = F.sequence(F.col("_pane.start") - whole + step, F.col("_pane.start"), step)
    spread = panes.select(F.explode(starts).alias("_start"), *by, "messages")
    counted = spread.groupBy("_start", *by).agg(F.sum("messages").alias("messages"))
    window = F.struct(F.col("_start").alias("start"), (F.col("_start") + whole).alias("end"))
    return counted.select(window.alias("window"), *by, "messages")


def _seconds(window: str = "window") -> Column:
    return F.unix_seconds(f"{window}.end") - F.unix_seconds(f"{window}.start")


def messages_by_topic(decoded: DataFrame) -> DataFrame:
    return (
        decoded.where(F.col("skip_reason").isNull())
        .groupBy("topic")
        .agg(F.count("*").alias("messages"))
    )


def message_counts(decoded: DataFrame, readings: DataFrame) -> DataFrame:
    """Messages received, skipped, decoded, accepted and rejected, one row per measure."""
    seen = decoded.agg(
        F.count("*").alias("received"),
        F.count("skip_reason").alias("skipped"),
        F.count_if(F.col("skip_reason").isNull()).alias("decoded"),
    ).unpivot([], ["received", "skipped", "decoded"], "measure", "n")
    read = readings.agg(
        F.count_if(F.col("error").isNull()).alias("accepted"),
        F.count("error").alias("rejected"),
    ).unpivot([], ["accepted", "rejected"], "measure", "n")
    return seen.unionByName(read)


def alerts_by_rule_user(alerts: DataFrame) -> DataFrame:
    """Triggered alerts per rule and user; resolved ones do not count."""
    return (
        alerts.where(F.col("status") == "Triggered")
        .groupBy("rule_id", "user_id")
        .agg(F.count("*").alias("alerts"))
    )


def message_rate(
    rows: DataFrame, ts: str = "ts", length: str = MINUTE, slide: str | None = None
) -> DataFrame:
    """Messages and messages per second in each window that has any."""
    return _counts(rows, ts, length, slide).select(
        F.col("window.start").alias("window_start"),
        "messages",
        (F.col("messages") / _seconds()).alias("per_second"),
    )


# Rows stored and rows per second: the same question asked of the stored rows.
write_rate = message_rate


def topic_counts(
    rows: DataFrame, ts: str = "ts", length: str = MINUTE, slide: str | None = None
) -> DataFrame:
    """Messages per window and topic: the small table most topic questions start from."""
    return _counts(rows, ts, length, slide, ("topic",))


def active_topics(
    rows: DataFrame, ts: str = "ts", length: str = MINUTE, slide: str | None = None
) -> DataFrame:
    """Topics with at least one message per window."""
    return (
        topic_counts(rows, ts, length, slide)
        .groupBy("window")
        .agg(F.count("*").alias("active"))
        .select(F.col("window.start").alias("window_start"), "active")
    )


def avg_topic_rate(
    rows: DataFrame, ts: str = "ts", length: str = MINUTE, slide: str | None = None
) -> DataFrame:
    """Messages per second and active topic in each window."""
    return (
        topic_counts(rows, ts, length, slide)
        .groupBy("window")
        .agg(F.sum("messages").alias("messages"), F.count("*").alias("active"))
        .select(
            F.col("window.start").alias("window_start"),
            (F.col("messages") / _seconds() / F.col("active")).alias("per_second_and_topic"),
        )
    )


def top_topics(
    rows: DataFrame,
    k: int = 5,
    ts: str = "ts",
    length: str = MINUTE,
    slide: str | None = None,
) -> DataFrame:
    """The ``k`` busiest topics of each window, ties by topic name."""
    return rank_topics(topic_counts(rows, ts, length, slide), k)


def rank_topics(counts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of ``topic_counts`` per window.

    Spark keeps only ``k`` rows per window and task before the shuffle.
    """
    ranked = Window.partitionBy("window").orderBy(F.desc("messages"), "topic")
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select(F.col("window.start").alias("window_start"), "rank", "topic", "messages")
    )


def top_topics_overall(rows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` busiest topics of all time, ties by topic name."""
    return (
        rows.groupBy("topic")
        .agg(F.count("*").alias("messages"))
        .orderBy(F.desc("messages"), "topic")
        .limit(k)
    )


def idle_topics(rows: DataFrame, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Per window: topics seen so far, active topics, and idle ones (seen but not active).

    Every window from the first to the last message has a row. The running total runs per day
    and adds the totals of the days before, so no task ever sees all windows of a long history.
    """
    start = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)
    seen = rows.select(start.alias("window_start"), "topic").distinct()
    firsts = seen.groupBy("topic").agg(F.min("window_start").alias("window_start"))
    per_window = (
        seen.select("window_start", F.lit(1).alias("_active"), F.lit(0).alias("_new"))
        .unionByName(
            firsts.select("window_start", F.lit(0).alias("_active"), F.lit(1).alias("_new"))
        )
        .groupBy("window_start")
        .agg(F.sum("_active").alias("_active"), F.sum("_new").alias("_new"))
    )
    # One row of bounds, then a row per day, spread out before it is exploded to windows.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    bounds = seen.agg(F.min("window_start").alias("low"), F.max("window_start").alias("high"))
    days = bounds.select(
        "low",
        "high",
        F.explode(
            F.sequence(F.to_date("low"), F.to_date("high"), F.expr("interval 1 day"))
        ).alias("day"),
    ).where(F.col("low").isNotNull())
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    first = F.greatest(F.col("low"), _first_window(F.col("day"), seconds))
    last = F.least(F.col("high"), _first_window(F.date_add("day", 1), seconds) - step)
    spine = (
        days.where(first <= last)
        .repartition(cores, "day")
        .select(F.explode(F.sequence(first, last, step)).alias("window_start"))
        .withColumn("day", F.to_date("window_start"))
    )
    filled = (
        spine.join(per_window, "window_start", "left")
        .select(
            "day",
            "window_start",
            F.coalesce("_active", F.lit(0)).alias("active"),
            F.coalesce("_new", F.lit(0)).alias("_new"),
        )
    )
    within = (
        Window.partitionBy("day")
        .orderBy("window_start")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # One row per day.
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    news = per_window.groupBy(F.to_date("window_start").alias("day")).agg(
        F.sum("_new").alias("_n")
    )
    day_totals = (
        days.join(news, "day", "left")
        .select("day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    known = F.col("_before") + F.sum("_new").over(within)
    return (
        filled.join(day_totals, "day")
        .select("window_start", known.alias("known"), "active")
        .withColumn("idle", F.col("known") - F.col("active"))
    )


def idle_windows(seen: DataFrame, firsts: DataFrame, seconds: int, last: datetime | None, known: int) -> DataFrame:
    """``idle_topics`` of the windows after ``last``, when ``known`` topics had been seen.

    ``seen`` has a row per window_start and topic, ``firsts`` the new topics with ``first_seen``. The
    running total goes over one row per window.
    """
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    bounds = seen.agg(F.min("window_start").alias("low"), F.max("window_start").alias("high"))
    low = F.col("low") if last is None else F.lit(last) + step
    spine = bounds.where(low <= F.col("high")).select(F.explode(F.sequence(low, "high", step)).alias("window_start"))
    active = seen.groupBy("window_start").agg(F.count(F.lit(1)).alias("_active"))
    news = firsts.groupBy(F.col("first_seen").alias("window_start")).agg(F.count(F.lit(1)).alias("_new"))
    filled = spine.join(active, "window_start", "left").join(news, "window_start", "left")
    until_now = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    total = F.lit(known) + F.sum(F.coalesce("_new", F.lit(0))).over(until_now)
    counted = filled.select("window_start", total.alias("known"), F.coalesce("_active", F.lit(0)).alias("active"))
    return counted.withColumn("idle", F.col("known") - F.col("active"))


def _first_window(day: Column, seconds: int) -> Column:
    """Start of the first window that begins on or after midnight of ``day``."""
    midnight = F.unix_seconds(day.cast("timestamp"))
    return F.timestamp_seconds(F.ceil(midnight / seconds) * seconds)


def alerts_per_minute(alerts: DataFrame, ts: str = "event_time", length: str = MINUTE) -> DataFrame:
    """Triggered alerts per window."""
    return (
        alerts.where(F.col("status") == "Triggered")
        .groupBy(F.window(ts, length).alias("window"))
        .agg(F.count("*").alias("alerts"))
        .select(F.col("window.start").alias("window_start"), "alerts")
    )


def errors_per_minute(rejected: DataFrame, ts: str = "ts", length: str = MINUTE) -> DataFrame:
    """Failed rows per window and reason."""
    return (
        rejected.groupBy(F.window(ts, length).alias("window"), error_class(F.col("error")).alias("reason"))
        .agg(F.count("*").alias("errors"))
        .select(F.col("window.start").alias("window_start"), "reason", "errors")
    )


def consumer_lag(messages: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows not yet read per source topic and partition; without a commit, the whole partition.

    ``committed`` has ``topic, partition, committed`` (the last offset read).
    """
    newest = messages.groupBy("topic", "partition").agg(F.max("offset").alias("newest"))
    return newest.join(committed, ["topic", "partition"], "left").select(
        "topic",
        "partition",
        "newest",
        "committed",
        (F.col("newest") - F.coalesce("committed", F.lit(-1).cast("bigint"))).alias("lag"),
    )


def counter_rate(
    samples: DataFrame,
    series: list[str],
    length: str = MINUTE,
) -> DataFrame:
    """Increase and rate per second of counters (``series..., ts, value``) in each window.

    A value below its predecessor means the counter was reset: the new value is the increase.
    The first sample of a series has no predecessor and adds nothing.
    """
    follow = ordered_groups(samples, series, ["ts", "value"])
    previous = F.col("_previous")
    grown = F.when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    return (
        follow.last_before(_previous=F.col("value"))
        .rows()
        .where(previous.isNotNull())
        .withColumn("_grown", grown)
        .groupBy(*series, F.window("ts", length).alias("window"))
        .agg(F.sum("_grown").alias("increase"))
        .select(
            *series,
            F.col("window.start").alias("window_start"),
            "increase",
            (F.col("increase") / _seconds()).alias("per_second"),
        )
    )


def gauge_last(samples: DataFrame, series: list[str]) -> DataFrame:
    """Newest sample of every series; of several at its time, the highest value. NULL is a series too."""
    newest = samples.groupBy(*series).agg(F.max("ts").alias("ts"))
    last = null_safe_join(samples.select(*series, "ts", "value"), newest, [*series, "ts"])
    return last.groupBy(*series, "ts").agg(F.max("value").alias("value"))


def status_map(gauges: DataFrame, names: dict[float, str] | None = None) -> DataFrame:
    """Add ``status``: the text of a gauge value, 1 = UP and 0 = DOWN unless told otherwise."""
    names = names or {1.0: "UP", 0.0: "DOWN"}
    status = F.lit(None).cast("string")
    for value, text in names.items():
        status = F.when(F.col("value") == value, F.lit(text)).otherwise(status)
    return gauges.withColumn("status", status)


def threshold_band(value: Column, steps: list[tuple[float, str]], base: str) -> Column:
    """Name of the highest step a value has reached, ``base`` below all steps."""
    band = F.lit(base)
    for bound, name in sorted(steps):
        band = F.when(value >= bound, F.lit(name)).otherwise(band)
    return F.when(value.isNotNull(), band)
