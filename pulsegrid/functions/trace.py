"""W3C trace context carried in message headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Version 00, 32 hex digits, 16 hex digits, 2 hex digits; all-zero ids are invalid.
TRACEPARENT = (
    r"\A(?!ff)[0-9a-f]{2}-(?!0{32})([0-9a-f]{32})-(?!0{16})([0-9a-f]{16})-([0-9a-f]{2})\z"
)


def header_text(headers: Column, name: str) -> Column:
    """Text of the first header called ``name``, NULL when absent."""
    found = F.filter(headers, lambda h: h["key"] == name)
    return F.get(found, F.lit(0))["value"].cast("string")


def trace_context(traceparent: Column) -> Column:
    """STRUCT<trace_id, span_id, flags> of a valid traceparent, else NULL."""
    part = F.split(traceparent, "-")
    return F.when(
        traceparent.rlike(TRACEPARENT),
        F.struct(
            F.get(part, F.lit(1)).alias("trace_id"),
            F.get(part, F.lit(2)).alias("span_id"),
            F.get(part, F.lit(3)).alias("flags"),
        ),
    )
