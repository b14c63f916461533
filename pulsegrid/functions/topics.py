"""Message topics: filters with wildcards, user ids, routes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_pattern(topic_filter: str) -> str:
    """Regular expression of a topic filter: ``+`` is one level, a final ``#`` any number."""
    if topic_filter == "#":
        return r"(?s)\A.*\z"
    levels = topic_filter.split("/")
    tail = ""
    if levels[-1] == "#":
        levels, tail = levels[:-1], "(/.*)?"
    parts = [
        "[^/]*" if level == "+" else re.sub(r"([^\w\s-])", r"\\\1", level) for level in levels
    ]
    return rf"(?s)\A{'/'.join(parts)}{tail}\z"


def match_topic_filter(topic: Column, topic_filter: str) -> Column:
    """Whether ``topic`` matches a filter known when the query is written."""
    return topic.rlike(filter_pattern(topic_filter))


def match_topic_levels(topic: Column, pattern: Column, substitutes: dict[str, Column]) -> Column:
    """Whether ``topic`` matches a filter held in a column, with placeholders such as ``%u``.

    Wildcards are recognised before placeholders are filled in, so a user named ``+`` gains
    nothing.
    """
    topic_levels = F.split(topic, "/", -1)
    levels = F.split(pattern, "/", -1)
    open_ended = F.element_at(levels, -1) == "#"
    fixed = F.when(open_ended, F.slice(levels, 1, F.size(levels) - 1)).otherwise(levels)

    def level_matches(have: Column, want: Column) -> Column:
        filled = want
        for mark, value in substitutes.items():
            named = F.contains(filled, F.lit(mark))
            filled = F.when(named, F.replace(filled, F.lit(mark), value)).otherwise(filled)
        return F.coalesce((want == "+") | (have == filled), F.lit(False))

    head = F.slice(topic_levels, 1, F.size(fixed))
    same_depth = F.size(topic_levels) == F.size(fixed)
    deep_enough = F.size(topic_levels) >= F.size(fixed)
    depth_ok = F.when(open_ended, deep_enough).otherwise(same_depth)
    return depth_ok & F.forall(F.zip_with(head, fixed, level_matches), lambda ok: ok)


def user_id_from_topic(topic: Column) -> Column:
    """User id of a telemetry topic, NULL when it has none.

    ``x/y/users/{id}`` wins over ``users/{id}``, so ``users/a/users/b`` gives ``b``.
    """
    part = F.split(topic, "/", -1)
    return F.when(
        (F.size(part) >= 4) & (F.get(part, F.lit(2)) == "users"), F.get(part, F.lit(3))
    ).when((F.size(part) >= 2) & (F.get(part, F.lit(0)) == "users"), F.get(part, F.lit(1)))


def control_route(topic: Column) -> Column:
    """``config``, ``manage`` or NULL for a topic on the control channel."""
    return F.when(F.endswith(topic, F.lit("/config")), F.lit("config")).when(
        F.endswith(topic, F.lit("/alerts/manage")), F.lit("manage")
    )


def maybe_control(text: Column) -> Column:
    """Whether JSON text may name a topic on the control channel, without opening it.

    Where nothing is escaped, the end of such a topic stands in the text as it is.
    """
    return F.contains(text, F.lit("/config")) | F.contains(text, F.lit("/alerts/manage")) | F.contains(text, F.lit("\\"))


def config_user(topic: Column) -> Column:
    """User id of ``users/{id}/config...``, else NULL."""
    part = F.split(topic, "/", -1)
    fits = (F.get(part, F.lit(0)) == "users") & (F.get(part, F.lit(2)) == "config")
    return F.when(fits, F.get(part, F.lit(1)))


def manage_user(topic: Column) -> Column:
    """User id of ``users/{id}/alerts/manage...``, else NULL."""
    part = F.split(topic, "/", -1)
    fits = (
        (F.get(part, F.lit(0)) == "users")
        & (F.get(part, F.lit(2)) == "alerts")
        & (F.get(part, F.lit(3)) == "manage")
    )
    return F.when(fits, F.get(part, F.lit(1)))


def alert_topic(user_id: Column) -> Column:
    return F.concat(F.lit("users/"), user_id, F.lit("/alerts"))
