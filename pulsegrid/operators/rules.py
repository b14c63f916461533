"""Per-user rule configurations and their evaluation on readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.rules import member_value, rule_holds, rule_member
from pulsegrid.functions.strict_json import as_number, as_text, members, parse_document
from pulsegrid.operators.once import computed_once
from pulsegrid.operators.ordered_groups import SLICE, ordered_groups
from pulsegrid.operators.storing import latest_by_key
from pulsegrid.schemas import DEFAULT_RULE, RULES

RULE_TYPE = RULES.simpleString()
#: Rule intervals of one user in one time bucket, about.
INTERVALS = 16


def default_rules() -> Column:
    return F.array(F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_RULE.items()])).cast(RULE_TYPE)


def no_rules() -> Column:
    return F.array().cast(RULE_TYPE)


def rule_parts(listed: Column) -> Column:
    """ARRAY<RULE> of a VARIANT list, with NULL for every element that is no complete rule."""

    def rule(m: Column) -> Column:
        part = {
            "key": as_text(F.try_element_at(m, F.lit("key"))),
            "operator": as_text(F.try_element_at(m, F.lit("operator"))),
            "threshold": as_number(F.try_element_at(m, F.lit("threshold"))),
            "message": as_text(F.try_element_at(m, F.lit("message"))),
        }
        whole = F.lit(True)
        for value in part.values():
            whole = whole & value.isNotNull()
        return F.when(whole, F.struct(*[v.alias(k) for k, v in part.items()]))

    # each element is opened once, not once per use
    items = F.transform(F.try_variant_get(listed, "$", "array<variant>"), members)
    return F.transform(items, rule).cast(RULE_TYPE)


def whole_rules(parts: Column) -> Column:
    """``rule_parts`` where every element is a complete rule, else NULL."""
    return F.when(F.forall(parts, lambda r: r.isNotNull()), parts)


def load_rules(stored: DataFrame) -> DataFrame:
    """Stored ``user_id, rules`` (JSON text) as typed rules; undecodable text gives no rules."""
    parsed = computed_once(stored, _doc=parse_document(F.col("rules")))
    parsed = computed_once(parsed, _parts=rule_parts(F.col("_doc")))
    return parsed.withColumn(
        "rules", F.coalesce(whole_rules(F.col("_parts")), no_rules())
    ).drop("_doc", "_parts")


def upsert_config(
    stored: DataFrame, updates: DataFrame, order: list[str]
) -> DataFrame:
    """New ``user_id, rules`` snapshot: per user the last update wins over what is stored.

    ``order`` names the columns that order the updates totally. What is stored stays where no update
    of the user comes; an anti join and a union, so a user with very many updates costs no more.
    """
    newest = latest_by_key(updates.select("user_id", "rules", *order), ["user_id"], order).select("user_id", "rules")
    kept = stored.select("user_id", "rules").join(newest.select("user_id"), "user_id", "left_anti")
    return kept.unionByName(newest)


def rules_for_user(readings: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``rules``: the user's own, the default rule without a stored row, none for no user.

    A stored empty list means no rules. The join is on ``rule_user``; Spark broadcasts the
    configurations when they are small and splits a skewed user otherwise.
    """
    stored = configs.select(F.col("user_id").alias("rule_user"), F.col("rules").alias("_rules"))
    return readings.join(stored, "rule_user", "left").select(
        *readings.columns,
        F.when(F.col("rule_user").isNotNull(), F.coalesce("_rules", default_rules())).alias(
            "rules"
        ),
    )


def rule_intervals(changes: DataFrame, at: str, tie: list[str], arrival: bool) -> DataFrame:
    """When each rule list held: ``user_id, _buckets, _start, _width, _bucket, _from, _to, _rules``.

    A user's changes are cut into about ``INTERVALS`` per bucket; an interval lies in every bucket it
    touches. Bucket 0 begins with the user's first change (``_start``, microseconds), each lasts ``_width``
    and the last one has no end. ``_from`` and ``_to`` are times, or with ``arrival`` places of messages.

    The change after a change is looked up within a slice of time, then among the slices of its user, so
    the changes of one user are many tasks' work.
    """
    def place(of: str | None = None) -> Column:
        return F.struct(*[F.col(f"{of}.{c}" if of else c).alias(c) for c in ([at, *tie] if arrival else [at])])

    # a change of no user meets no reading
    rows = changes.where("user_id IS NOT NULL").select("user_id", at, *tie, "rules")
    rows = ordered_groups(rows, ["user_id"], [at, *tie]).df
    in_slice = Window.partitionBy("user_id", SLICE).orderBy(at, *tie)
    local = rows.select("*", F.lead(F.struct(at, *tie)).over(in_slice).alias("_after"))
    micros = F.unix_micros(at)
    slices = rows.groupBy("user_id", SLICE).agg(
        F.min(F.struct(at, *tie)).alias("_begin"),
        F.min(micros).alias("_low"),
        F.max(micros).alias("_high"),
        F.count(F.lit(1)).alias("_n"),
    )
    all_of = Window.partitionBy("user_id")
    first, last = F.min("_low").over(all_of), F.max("_high").over(all_of)
    cut = F.ceil(F.sum("_n").over(all_of) / INTERVALS).cast("long")
    users = slices.select(
        "user_id",
        SLICE,
        F.lead("_begin").over(all_of.orderBy(SLICE)).alias("_begin"),
        first.alias("_first"),
        F.coalesce(first, F.lit(0)).alias("_start"),
        # a change before all times has no time of its own: its user's buckets begin with the others
        F.ceil((F.coalesce(last, F.lit(0)) - F.coalesce(first, F.lit(0)) + 1) / cut).cast("long").alias("_width"),
        cut.alias("_buckets"),
    )
    rows = local.join(users, ["user_id", SLICE]).withColumn("_after", F.coalesce("_after", "_begin"))
    rows = rows.select(
        "user_id",
        F.coalesce(micros, "_first").alias("_micros"),
        "_start",
        "_width",
        "_buckets",
        place().alias("_from"),
        F.when(F.col("_after").isNotNull(), place("_after")).alias("_to"),
        F.unix_micros(f"_after.{at}").alias("_next"),
        F.col("rules").alias("_rules"),
    )
    rows = rows.where("_to IS NULL OR _from < _to")
    one, two = _bucket(F.coalesce("_micros", "_start")), F.coalesce(_bucket(F.col("_next")), F.col("_buckets") - 1)
    return rows.select("user_id", "_buckets", "_start", "_width", F.explode(F.sequence(one, two)).alias("_bucket"), "_from", "_to", "_rules")


def _bucket(micros: Column) -> Column:
    """Bucket of a time among those of a user."""
    number = F.floor((micros - F.col("_start")) / F.col("_width")).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(number, F.col("_buckets") - 1))


def rules_as_of(
    readings: DataFrame,
    changes: DataFrame,
    at: str = "time",
    tie: tuple[str, ...] = ("sequence_id",),
    arrival: bool = False,
) -> DataFrame:
    """Add ``rules`` as they stood when the reading came: a change affects later rows only.

    ``changes`` has ``user_id, rules, <at>`` and may carry the ``tie`` columns; a change at the
    very time of a reading counts for it, unless ``arrival`` says that ``tie`` orders all messages:
    then only a change before the reading does. Users without an earlier change get the default rule.

    Readings are not ordered and not written down. They learn their user's buckets, a row per user, and
    meet the few intervals of their bucket. Both are equi-joins, so Spark may broadcast a small side and
    split a user with most of the readings.
    """
    ties = [c for c in tie if c in changes.columns]
    intervals = rule_intervals(changes, at, ties, arrival)
    cuts = intervals.select("user_id", "_buckets", "_start", "_width").distinct()
    # readings of no user meet nothing, each under a key of its own
    nobody = F.concat(F.lit("\0"), F.xxhash64(at, *tie).cast("string"))
    keyed = readings.withColumn("_user", F.coalesce("rule_user", nobody))
    known = keyed.join(cuts.withColumnRenamed("user_id", "_user"), "_user", "left")
    placed = known.withColumn("_bucket", F.coalesce(_bucket(F.unix_micros(at)), F.lit(0).cast("long")))
    here = F.struct(at, *ties) if arrival else F.struct(at)
    listed = intervals.select(
        F.col("user_id").alias("_of_user"), F.col("_bucket").alias("_of_bucket"), "_from", "_to", "_rules"
    )
    held = (here >= F.col("_from")) & (F.col("_to").isNull() | (here < F.col("_to")))
    same = (F.col("_user") == F.col("_of_user")) & (F.col("_bucket") == F.col("_of_bucket"))
    found = placed.join(listed, same & held, "left")
    rules = F.when(F.col("rule_user").isNotNull(), F.coalesce("_rules", default_rules()))
    return found.select(*readings.columns, rules.alias("rules"))


def explode_rules(readings: DataFrame) -> DataFrame:
    """One row per reading and rule, ``pos`` keeping the list order; no rules, no rows."""
    return readings.select("*", F.posexplode("rules").alias("pos", "rule")).drop("rules")


def evaluate_rules(ruled: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Evaluate every rule of every reading; rules that find no number give no row.

    Result: user_id, device_id, rule_id, pos, time, sequence_id, value, message, triggered, and
    the ``carry`` columns. ``rule_id`` is the rule's key, so rules on one key share one alert.
    """
    rows = computed_once(explode_rules(ruled), _member=rule_member(F.col("rule.key"), F.col("extras")))
    rows = computed_once(rows, value=member_value(F.col("rule.key"), F.col("_member")))
    return rows.where(F.col("value").isNotNull()).select(
        "user_id",
        "device_id",
        F.col("rule.key").alias("rule_id"),
        "pos",
        "time",
        "sequence_id",
        "value",
        F.col("rule.message").alias("message"),
        rule_holds(F.col("value"), F.col("rule.operator"), F.col("rule.threshold")).alias(
            "triggered"
        ),
        *carry,
    )
