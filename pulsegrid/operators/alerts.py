"""Alerts: when they trigger, resolve, are snoozed or disabled, and what is active.

The state of an alert (user, device, rule) follows from its ordered inputs without a loop:

* Between two snoozes (an *epoch*), the alert exists exactly if the last evaluation was true, or
  if nothing was evaluated yet and it existed when the epoch began.
* A disable works if the alert exists, and then lasts to the end of the epoch: only a snooze
  leaves that state.
* So an epoch turns "existed at the start" into a constant or leaves it as it was, and the last
  constant before a row says whether the alert existed when the row's epoch began.

Each of these is a "last value before this row", which keeps working for groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.topics import alert_topic
from pulsegrid.operators.ordered_groups import ordered_groups
from pulsegrid.schemas import ALERT_KEYS

ORDER = ["time", "sequence_id", "pos"]
RESOLVED_MESSAGE = "Alert Resolved"  # fixed value


def make_alert(changes: DataFrame) -> DataFrame:
    """Alert rows from rows with ``status``; a resolved alert has its own message and no value."""
    resolved = F.col("status") == "Resolved"
    return changes.select(
        F.col("time").alias("event_time"),
        *ALERT_KEYS,
        F.concat(F.lit("Rule:"), F.col("rule_id")).alias("alert_type"),
        F.when(resolved, F.lit(RESOLVED_MESSAGE)).otherwise(F.col("message")).alias("message"),
        F.when(~resolved, F.col("value")).alias("value"),
        "status",
    )


def publish_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows as ``topic, key, value`` messages on ``users/{user}/alerts``."""
    fields = [c for c in alerts.columns]
    return alerts.select(
        alert_topic(F.col("user_id")).alias("topic"),
        F.col("user_id").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
    )


def _edges(evaluations: DataFrame, order: list[str] | None) -> DataFrame:
    """Evaluations with ``_was``: whether the one before them held; false for the first."""
    columns = [c for c in evaluations.columns if c != "_was"]
    groups = ordered_groups(evaluations.select(*columns), ALERT_KEYS, order or ORDER)
    rows = groups.last_before(_was=F.col("triggered")).rows()
    return rows.withColumn("_was", F.coalesce("_was", F.lit(False)))


def alert_transitions(evaluations: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Alert history without commands: a rising edge triggers, a falling edge resolves."""
    status = F.when(F.col("triggered"), F.lit("Triggered")).otherwise(F.lit("Resolved"))
    changed = _edges(evaluations, order).where(F.col("triggered") != F.col("_was"))
    return make_alert(changed.withColumn("status", status))


def active_alerts_asof(
    evaluations: DataFrame,
    as_of: Column | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Alerts active after all evaluations (or those up to ``as_of``), without commands.

    An alert is active if its last evaluation is true, and started at its last rising edge.
    """
    order = order or ORDER
    rows = evaluations if as_of is None else evaluations.where(F.col("time") <= as_of)
    rows = rows.select(*dict.fromkeys([*ALERT_KEYS, *order, "time", "triggered", "value"]))
    place = [F.col(c) for c in order]
    rising = F.col("triggered") & ~F.col("_was")
    last = _edges(rows, order).groupBy(*ALERT_KEYS).agg(
        F.max(F.struct(*place, F.struct("time", "triggered", "value").alias("row")))["row"].alias("_last"),
        F.max(F.when(rising, F.struct(*place, F.col("time").alias("at"))))["at"].alias("start_time"),
    )
    return last.where(F.col("_last.triggered")).select(
        *ALERT_KEYS,
        "start_time",
        F.col("_last.time").alias("last_seen"),
        F.lit("Active").alias("status"),
        F.lit(None).cast("timestamp").alias("snooze_until"),
        F.col("_last.value").alias("current_value"),
    )


# The first and the last moment a date of four digits can name, in microseconds.
FIRST_MICROS = -62_135_596_800_000_000
LAST_MICROS = 253_402_300_799_999_999
# A snooze of more minutes than lie between them ends at one of them.
ALL_MINUTES = (LAST_MICROS - FIRST_MICROS) // 60_000_000 + 1


def inputs(evaluations: DataFrame, commands: DataFrame, clock: str) -> DataFrame:
    """Evaluations and commands as one kind of row. Any snooze has an end within the calendar."""
    as_evaluations = evaluations.selectExpr(
        *ALERT_KEYS,
        f"{clock} AS clock",
        "0 AS kind",
        "sequence_id",
        "pos",
        "time",
        "value",
        "message",
        "triggered",
        "CAST(NULL AS STRING) AS action",
        "CAST(NULL AS TIMESTAMP) AS until",
        "true AS fresh",
    )
    as_commands = commands.selectExpr(
        *ALERT_KEYS,
        f"{clock} AS clock",
        "1 AS kind",
        "sequence_id",
        "0 AS pos",
        "CAST(NULL AS TIMESTAMP) AS time",
        "CAST(NULL AS DOUBLE) AS value",
        "CAST(NULL AS STRING) AS message",
        "CAST(NULL AS BOOLEAN) AS triggered",
        "action",
        f"""CASE WHEN action = 'SNOOZE'
            THEN timestamp_micros(greatest({FIRST_MICROS}, least({LAST_MICROS}, unix_micros({clock})
                + 60000000 * greatest(-{ALL_MINUTES}, least({ALL_MINUTES}, duration_minutes)))))
            END AS until""",
        "true AS fresh",
    )
    return as_evaluations.unionByName(as_commands)


def _from_state(active: DataFrame, sequence: str) -> DataFrame:
    """Stored alerts as the inputs that lead to them, placed before everything else.

    A true evaluation at the start, one when last seen, and the command that gave the status.
    """
    steps = """
        stack(3, 0, start_time, true, CAST(NULL AS STRING), CAST(NULL AS TIMESTAMP),
                 1, last_seen, true, NULL, NULL,
                 2, CAST(NULL AS TIMESTAMP), CAST(NULL AS BOOLEAN),
                    CASE status WHEN 'Snoozed' THEN 'SNOOZE' WHEN 'Disabled' THEN 'DISABLE' END,
                    snooze_until)
        AS (pos, time, triggered, action, until)"""
    replayed = active.selectExpr(*ALERT_KEYS, "current_value", steps)
    return replayed.where("triggered OR action IS NOT NULL").selectExpr(
        *ALERT_KEYS,
        "CAST(NULL AS TIMESTAMP) AS clock",
        "0 AS kind",
        f"CAST(NULL AS {sequence}) AS sequence_id",
        "pos",
        "time",
        "CASE WHEN triggered THEN current_value END AS value",
        "CAST(NULL AS STRING) AS message",
        "triggered",
        "action",
        "until",
        "false AS fresh",
    )


# In batch, commands follow the evaluations of their time; live, everything counts as it arrived.
INPUT_ORDER = ["clock", "kind", "sequence_id", "pos"]
ARRIVAL_ORDER = ["clock", "sequence_id", "kind", "pos"]


def _in_epoch(what: str) -> Column:
    """Whether the named earlier row lies in the current epoch."""
    return F.expr(f"{what} IS NOT NULL AND (_snooze IS NULL OR {what}.at > _snooze.at)")


def _after_commands(rows: DataFrame) -> DataFrame:
    """Add what the commands before a row make of it: _disabled_in, _maybe_in and _existed.

    Only commands change these, so they are worked out on the command rows and reach all others by the
    place of the last command before them. The commands of one alert, few beside its evaluations, are
    one task's work.
    """
    by_order = [F.col("_at")]
    epoch = Window.partitionBy(*ALERT_KEYS, "_snooze.at").orderBy(*by_order)
    alert = Window.partitionBy(*ALERT_KEYS).orderBy(*by_order)
    until_now, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)

    def any_of(condition: str, rows_between: tuple[int, int]) -> Column:
        return F.coalesce(F.max(F.expr(condition)).over(epoch.rowsBetween(*rows_between)), F.lit(False))

    # A disable after a true evaluation works; one before any evaluation works if the alert existed
    # when the epoch began; one after a false evaluation finds nothing.
    works, may_work = "action = 'DISABLE' AND _last_true", "action = 'DISABLE' AND NOT _evaluated"
    known = rows.where("action IS NOT NULL").select(
        *ALERT_KEYS, "_at", "action", "_evaluated", "_last_true",
        any_of(works, until_now).alias("_disabled"), any_of(works, before).alias("_disabled_in"),
        any_of(may_work, until_now).alias("_maybe"), any_of(may_work, before).alias("_maybe_in"),
    )
    # What an ended epoch says about the existence of the alert; NULL leaves it as it was.
    ended = F.expr(
        """CASE WHEN action = 'SNOOZE' THEN
             CASE WHEN _disabled_in OR _last_true THEN true
                  WHEN _evaluated AND NOT _maybe_in THEN false END
           END"""
    )
    known = known.withColumn("_ended", ended).select(
        *[F.col(c).alias(f"_of_{c}") for c in ALERT_KEYS],
        F.col("_at").alias("_of_at"),
        # a snooze begins an epoch without commands
        F.expr("action = 'DISABLE' AND _disabled").alias("_disabled_in"),
        F.expr("action = 'DISABLE' AND _maybe").alias("_maybe_in"),
        F.last("_ended", ignorenulls=True).over(alert.rowsBetween(*until_now)).alias("_existed"),
    )
    same = F.col("_command") == F.col("_of_at")
    for key in ALERT_KEYS:
        same = same & (F.col(key) == F.col(f"_of_{key}"))
    joined = rows.join(known, same, "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("_disabled_in", "_maybe_in")]
    return joined.select(*rows.columns, *flags, "_existed")


def follow_alerts(
    evaluations: DataFrame,
    commands: DataFrame,
    active: DataFrame | None = None,
    clock: str = "time",
    order: list[str] | None = None,
) -> DataFrame:
    """Every input of every alert with what it did: the base of history and current state.

    ``commands`` has user_id, device_id, rule_id, action, duration_minutes, sequence_id and the
    ``clock`` column; ``active`` is an earlier snapshot to go on from. The clock column orders
    the inputs and decides when a snooze has run out: message time in batch, arrival time live.
    ``order`` is INPUT_ORDER, or ARRIVAL_ORDER where ``sequence_id`` orders all messages.
    """
    order = order or INPUT_ORDER
    rows = inputs(evaluations, commands, clock)
    if active is not None:
        sequence = rows.schema["sequence_id"].dataType.simpleString()
        rows = rows.unionByName(_from_state(active, sequence))
    rows = (
        ordered_groups(rows, ALERT_KEYS, order)
        .with_columns(_at=F.struct(*order))
        .last_before(
            _snooze=F.expr("CASE WHEN action = 'SNOOZE' THEN struct(_at AS at, until) END"),
            _eval=F.expr(
                "CASE WHEN triggered IS NOT NULL THEN struct(_at AS at, triggered, clock) END"
            ),
            _false=F.expr("CASE WHEN NOT triggered THEN struct(_at AS at) END"),
            _command=F.expr("CASE WHEN action IS NOT NULL THEN _at END"),
        )
        .with_columns(_evaluated=_in_epoch("_eval"), _had_false=_in_epoch("_false"))
        .with_columns(_last_true=F.expr("_evaluated AND _eval.triggered"))
        .rows()
    )
    rows = _after_commands(rows)
    rows = rows.withColumn("_existed", F.expr("coalesce(_existed, false)"))
    rows = rows.withColumns(
        {
            "blocked": F.expr("_disabled_in OR (_maybe_in AND _existed)"),
            # A snooze without an end never runs out.
            "_over": F.expr("coalesce(_snooze.until < clock, false)"),
            "_over_before": F.expr("_evaluated AND coalesce(_snooze.until < _eval.clock, false)"),
        }
    )
    rows = rows.withColumns(
        {
            "existed": F.expr("blocked OR _last_true OR (NOT _evaluated AND _existed)"),
            # The epoch's snooze found an alert, and nothing has resolved or woken it since.
            "snoozed": F.expr(
                """_existed AND NOT blocked AND NOT _had_false AND _snooze IS NOT NULL
                   AND NOT _over_before"""
            ),
        }
    )
    status = """
        CASE WHEN NOT fresh OR blocked THEN NULL
             WHEN triggered AND (NOT existed OR (snoozed AND _over)) THEN 'Triggered'
             WHEN NOT triggered AND existed THEN 'Resolved' END"""
    return rows.withColumn("status", F.expr(status))


def alert_history_with_commands(
    evaluations: DataFrame,
    commands: DataFrame,
    active: DataFrame | None = None,
    clock: str = "time",
) -> DataFrame:
    """Alert history under snooze and disable commands."""
    followed = follow_alerts(evaluations, commands, active, clock)
    return make_alert(followed.where(F.col("status").isNotNull()))


def alert_state_after(followed: DataFrame) -> DataFrame:
    """Snapshot of all alerts after the inputs of ``follow_alerts``."""
    exists = "CASE WHEN triggered THEN true WHEN NOT triggered THEN blocked ELSE existed END"
    status = """
        CASE WHEN action = 'SNOOZE' THEN 'Snoozed'
             WHEN action = 'DISABLE' OR blocked THEN 'Disabled'
             WHEN snoozed AND NOT _over THEN 'Snoozed' ELSE 'Active' END"""
    until = "CASE WHEN action = 'SNOOZE' THEN until ELSE _snooze.until END"
    return (
        followed.groupBy(*ALERT_KEYS)
        .agg(
            F.expr(f"max(struct(_at, {exists} AS live, {status} AS s, {until} AS u)) AS _last"),
            # An alert begins with the true evaluation that found none.
            F.expr("max(CASE WHEN triggered AND NOT existed THEN struct(_at, time) END) AS _start"),
            # A true evaluation refreshes the alert, whatever its status.
            F.expr("max(CASE WHEN triggered THEN struct(_at, time, value) END) AS _seen"),
        )
        .where("_last.live")
        .selectExpr(
            *ALERT_KEYS,
            "_start.time AS start_time",
            "_seen.time AS last_seen",
            "_last.s AS status",
            "CASE WHEN _last.s = 'Snoozed' THEN _last.u END AS snooze_until",
            "_seen.value AS current_value",
        )
    )
