"""Threshold rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.strict_json import as_number

# Fixed value: double precision machine epsilon, the tolerance of ``==``.
EPSILON = 2.220446049250313e-16

# Fixed value: paths that VARIANT accepts below the top-level name.
PATH = (
    r"\A\$(\.[^.\[\s][^.\[]*|\[[0-9]{1,9}\]|\['[^'?\s][^'?]*'\]|"
    r'\["[^"?\s][^"?]*"\])*\z'
)


def rule_value(key: Column, extras: Column) -> Column:
    """Number a rule looks at: temperature, battery, or a numeric extra of that name.

    ``extras`` is MAP<STRING, VARIANT>. A key starting with ``$.`` that no extra carries
    literally is read as a JSON path, which reaches nested fields; a malformed path finds nothing.
    """
    return member_value(key, rule_member(key, extras))


def rule_member(key: Column, extras: Column) -> Column:
    """VARIANT that a rule on an extra looks at; NULL for the keys of readings' own columns."""
    literal = F.try_element_at(extras, key)
    first, rest = nested_parts(key)
    # A malformed path would stop the query, not just give NULL.
    path = F.when(rest.rlike(PATH), rest)
    nested = F.try_variant_get(F.try_element_at(extras, first), path, "variant")
    return F.when(~key.isin("temperature", "battery"), F.coalesce(literal, F.when(F.startswith(key, F.lit("$.")), nested)))


def member_value(key: Column, member: Column) -> Column:
    """Number a rule looks at, from its ``rule_member``."""
    return (
        F.when(key == "temperature", F.col("temperature"))
        .when(key == "battery", F.col("battery").cast("double"))
        .otherwise(as_number(member))
    )


def nested_parts(key: Column) -> tuple[Column, Column]:
    """Split ``$.a.b.c`` into the top-level name ``a`` and the remaining path ``$.b.c``."""
    first = F.regexp_extract(key, r"\A\$\.([^.\[]+)", 1)
    return first, F.concat(F.lit("$"), F.substring(key, F.length(first) + 3, F.length(key)))


def rule_holds(value: Column, operator: Column, threshold: Column) -> Column:
    """Whether the comparison holds; an unknown operator never does."""
    return (
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", F.abs(value - threshold) < EPSILON)
        .otherwise(F.lit(False))
    )
