"""Control messages: rule updates and alert commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.strict_json import (
    as_integer,
    as_text,
    json_type,
    members,
    parse_document,
)
from pulsegrid.functions.topics import config_user, control_route, manage_user
from pulsegrid.operators.once import computed_once
from pulsegrid.operators.rules import no_rules, rule_parts, whole_rules

# Fixed values.
DEFAULT_SNOOZE_MINUTES = 30
ACTIONS = ["SNOOZE", "DISABLE"]


def route_control(messages: DataFrame) -> DataFrame:
    """Add ``route`` to ``topic, payload`` rows; topics of neither route are left out."""
    return messages.withColumn("route", control_route(F.col("topic"))).where(
        F.col("route").isNotNull()
    )


def parse_config_update(routed: DataFrame) -> DataFrame:
    """Rule updates: adds ``user_id, rules, error``. A missing list means no rules."""
    m = members(parse_document(F.col("payload")))
    listed = F.try_element_at("_m", F.lit("rules"))
    routed = computed_once(routed.where(F.col("route") == "config"), _m=m)
    routed = routed.withColumn("_listed", listed)
    routed = computed_once(routed, _parts=rule_parts(F.col("_listed")))
    return (
        routed.withColumn("user_id", config_user(F.col("topic")))
        .withColumn(
            "rules",
            F.when(F.col("_m").isNotNull() & F.col("_listed").isNull(), no_rules()).otherwise(
                whole_rules(F.col("_parts"))
            ),
        )
        .withColumn(
            "error",
            F.when(F.col("user_id").isNull(), F.lit("not_a_config_topic")).when(
                F.col("rules").isNull(), F.lit("bad_config")
            ),
        )
        .drop("_m", "_listed", "_parts")
    )


def parse_command(routed: DataFrame) -> DataFrame:
    """Alert commands: adds ``user_id, device_id, rule_id, action, duration_minutes, error``.

    ``error`` is ``not_a_manage_topic``, ``bad_command``, ``unknown_action`` or NULL. Actions are
    case-sensitive; a snooze without duration lasts 30 minutes.
    """

    def member(name: str):
        return F.try_element_at("_m", F.lit(name))

    minutes = member("duration_minutes")
    unset = minutes.isNull() | (json_type(minutes) == "VOID")
    routed = computed_once(
        routed.where(F.col("route") == "manage"), _m=members(parse_document(F.col("payload")))
    )
    return (
        routed.withColumn("user_id", manage_user(F.col("topic")))
        .withColumn("device_id", as_text(member("device_id")))
        .withColumn("rule_id", as_text(member("rule_id")))
        .withColumn("action", as_text(member("action")))
        .withColumn(
            "duration_minutes",
            F.when(unset, F.lit(DEFAULT_SNOOZE_MINUTES).cast("bigint")).otherwise(
                as_integer(minutes)
            ),
        )
        .withColumn(
            "error",
            F.when(F.col("user_id").isNull(), F.lit("not_a_manage_topic"))
            .when(
                F.col("device_id").isNull()
                | F.col("rule_id").isNull()
                | F.col("action").isNull()
                | F.col("duration_minutes").isNull(),
                F.lit("bad_command"),
            )
            .when(~F.col("action").isin(ACTIONS), F.lit("unknown_action")),
        )
        .drop("_m")
    )
