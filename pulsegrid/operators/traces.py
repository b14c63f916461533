"""Trace context of messages: extraction, batch links, OTLP spans, ingress latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.trace import trace_context
from pulsegrid.operators.quantiles import summary

SHARES = {"p50": 0.5, "p95": 0.95}


def extract_traceparent(decoded: DataFrame) -> DataFrame:
    """Add ``trace_id, span_id, flags`` from ``traceparent``; all NULL when it is not valid."""
    context = trace_context(F.col("traceparent"))
    return decoded.withColumn("_c", context).select(
        *decoded.columns,
        F.col("_c.trace_id").alias("trace_id"),
        F.col("_c.span_id").alias("span_id"),
        F.col("_c.flags").alias("flags"),
    )


def batch_links(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Links from a batch to the traces of its rows, one row per link; invalid ones are dropped."""
    traced = extract_traceparent(rows.select(batch, "traceparent"))
    return traced.where(F.col("trace_id").isNotNull()).select(
        batch, "trace_id", "span_id", "flags"
    )


def batch_summary(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows and valid links per batch."""
    traced = extract_traceparent(rows.select(batch, "traceparent"))
    return traced.groupBy(batch).agg(
        F.count("*").alias("rows"), F.count("trace_id").alias("links")
    )


def to_otlp_spans(wrapped: DataFrame, start: Column | None = None) -> DataFrame:
    """One ingress span per message as OTLP JSON in ``message``; the span lasts 1 ms."""
    start = F.current_timestamp() if start is None else start
    nanos = F.unix_micros(start) * 1000

    def text_attribute(key: str, value: Column) -> Column:
        return F.struct(
            F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value")
        )

    # Service and scope names, span name, kind 3 (producer), status code 1 (ok).
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.lit("mqtt_ingress").alias("name"),
        F.lit(3).alias("kind"),
        nanos.cast("string").alias("startTimeUnixNano"),
        (nanos + 1_000_000).cast("string").alias("endTimeUnixNano"),
        F.array(text_attribute("topic", F.col("topic"))).alias("attributes"),
        F.struct(F.lit(1).alias("code")).alias("status"),
    )
    scope = F.struct(
        F.struct(F.lit("vector").alias("name")).alias("scope"), F.array(span).alias("spans")
    )
    resource = F.struct(
        F.struct(
            F.array(text_attribute("service.name", F.lit("vector-bridge"))).alias("attributes")
        ).alias("resource"),
        F.array(scope).alias("scopeSpans"),
    )
    return wrapped.select(
        F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("message")
    )


def ingress_latency(
    rows: DataFrame, received: Column, sent_ms: Column, groups: list[str]
) -> DataFrame:
    """Milliseconds from ``ingest_timestamp`` to receipt: count, average, median, p95, extremes."""
    latency = (F.unix_millis(received) - sent_ms).alias("latency_ms")
    return summary(rows.select(*groups, latency), "latency_ms", groups, SHARES)


def payload_size_stats(decoded: DataFrame) -> DataFrame:
    """Payload bytes per topic: count, average, median, p95, minimum and maximum."""
    sizes = decoded.where(F.col("skip_reason").isNull()).select("topic", F.octet_length("payload").alias("bytes"))
    return summary(sizes, "bytes", ["topic"], SHARES)
