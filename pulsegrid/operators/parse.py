"""Strict parsing and validation of readings, driven by a DomainSpec."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.strict_json import (
    READERS,
    json_type,
    members,
    named_members,
    parse_document,
)
from pulsegrid.functions.topics import match_topic_filter, user_id_from_topic
from pulsegrid.operators.once import computed_once
from pulsegrid.schemas import TELEMETRY, DomainSpec, Field

UNKNOWN_USER = "unknown"


def _member(field: Field) -> Column:
    return F.col(f"_f.{field.name}")


def _problem(field: Field) -> Column:
    """What is wrong with a field whose typed column is NULL, if anything."""
    kind = json_type(_member(field))
    wrong = F.concat(F.lit(f"Invalid JSON: invalid value for `{field.name}` of type "), kind)
    if field.required:
        missing = F.lit(f"Invalid JSON: missing field `{field.name}`")
        found = F.when(_member(field).isNull(), missing).otherwise(wrong)
    else:
        found = F.when(kind != "VOID", wrong)
    return F.when(F.col(field.name).isNull(), found)


def parse_readings(decoded: DataFrame, spec: DomainSpec = TELEMETRY) -> DataFrame:
    """Type the JSON in ``document`` (or, without that column, in the text ``payload``).

    Adds the spec's columns, ``extras``, ``extra_data`` and ``error``, which is NULL for a valid
    row, else the first failing check. Unknown top-level members go to ``extras`` (MAP<STRING,
    VARIANT>) and, as JSON text, to ``extra_data`` (``{}`` if none). No shuffle.
    """
    if "document" not in decoded.columns:
        decoded = computed_once(decoded, document=parse_document(F.col("payload")))
    opened = computed_once(decoded, _f=named_members(F.col("document"), spec.names))
    typed = computed_once(opened, **{f.name: READERS[f.kind](_member(f)) for f in spec.fields})
    checks = [F.when(F.col("_f").isNull(), F.lit("Invalid JSON: not an object"))]
    checks += [_problem(f) for f in spec.fields]
    checks += [
        F.when(F.col(f.name) == "", F.lit(f"Empty {f.name}")) for f in spec.fields if f.non_empty
    ]
    known = spec.names
    extras = F.map_filter(members(F.col("document")), lambda name, _: ~name.isin(known))
    return (
        typed.withColumn("error", F.coalesce(*checks))
        .withColumn("extras", extras)
        .withColumn("extra_data", F.to_json("extras"))
        .drop("_f")
    )


def stamp_user(readings: DataFrame) -> DataFrame:
    """Add ``user_id`` from the topic, ``unknown`` if it names none, and nullable ``rule_user``.

    The user always comes from the topic, never from the payload. Rows of the unknown user are
    kept but run no rules, hence the second column.
    """
    return readings.withColumn("rule_user", user_id_from_topic(F.col("topic"))).withColumn(
        "user_id", F.coalesce("rule_user", F.lit(UNKNOWN_USER))
    )


def parse_telemetry(decoded: DataFrame) -> DataFrame:
    """Decoded messages to typed telemetry with ``error``; skipped messages are left out."""
    return stamp_user(parse_readings(decoded.where(F.col("skip_reason").isNull()), TELEMETRY))


def parse_domain(decoded: DataFrame, spec: DomainSpec) -> DataFrame:
    """Decoded messages on the topics of a domain to its typed readings with ``error``."""
    own = F.col("skip_reason").isNull() & match_topic_filter(F.col("topic"), spec.topic_filter)
    return stamp_user(parse_readings(decoded.where(own), spec))


def split_accept_reject(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and failed rows; every input row is in exactly one of the two."""
    return (
        readings.where(F.col("error").isNull()),
        readings.where(F.col("error").isNotNull()),
    )


def range_validate(readings: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Mark valid rows whose value lies outside its inclusive bounds as failed; NULL passes."""
    outside = reduce(
        lambda found, item: F.coalesce(
            found,
            F.when(
                ~F.col(item[0]).between(*item[1]), F.lit(f"Out of range: {item[0]}")
            ),
        ),
        bounds.items(),
        F.lit(None).cast("string"),
    )
    return readings.withColumn("error", F.coalesce("error", outside))


def error_class(error: Column) -> Column:
    """Reason without detail: the text up to the first colon."""
    return F.substring_index(error, ":", 1)


def matching_alerts(
    readings: DataFrame, tests: dict[str, tuple[str, str, str]]
) -> DataFrame:
    """Stateless alerts for any domain.

    ``tests`` maps an alert type to SQL expressions for (condition, message, value). A row gives
    one alert for every condition that is true; the row's columns are kept.
    """
    candidates = [
        F.when(
            F.expr(condition),
            F.struct(
                F.lit(name).alias("alert_type"),
                F.expr(message).cast("string").alias("message"),
                F.expr(value).cast("double").alias("value"),
            ),
        )
        for name, (condition, message, value) in tests.items()
    ]
    found = F.filter(F.array(*candidates), lambda alert: alert.isNotNull())
    return readings.select("*", F.inline(found))


def find_message(readings: DataFrame, device_id: str, sequence_id: int) -> DataFrame:
    """Rows of one device and sequence number; over stored rows, the filter reaches the scan."""
    return readings.where(
        (F.col("device_id") == device_id) & (F.col("sequence_id") == sequence_id)
    )
