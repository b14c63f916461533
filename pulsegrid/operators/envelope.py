"""Message envelopes ``{topic, payload}``: wrapping raw messages and opening them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.strict_json import (
    as_text,
    json_type,
    members,
    named_members,
    parse_document,
    quoted,
)
from pulsegrid.functions.trace import header_text
from pulsegrid.operators.once import computed_once


def _wrapped(topic: Column, payload: Column) -> Column:
    return F.concat(
        F.lit('{"topic":'), quoted(topic), F.lit(',"payload":'), payload, F.lit("}")
    )


def bridge_wrap(raw: DataFrame) -> DataFrame:
    """Wrap raw ``topic, message`` rows; adds ``value`` and ``error``.

    ``value`` is NULL where the message is not one JSON document, with ``error`` saying so. The
    message text goes in unchanged, so numbers keep their exact spelling.
    """
    valid = parse_document(F.col("message")).isNotNull()
    return computed_once(raw, _ok=valid).select(
        *raw.columns,
        F.when(F.col("_ok"), _wrapped(F.col("topic"), F.trim(F.col("message")))).alias("value"),
        F.when(~F.coalesce(F.col("_ok"), F.lit(False)), F.lit("not_json")).alias("error"),
    )


def bridge_wrap_enriched(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Wrap raw messages with arrival time and a new W3C trace context.

    Adds ``value``, ``error``, ``trace_id``, ``span_id``, ``traceparent`` and ``headers``. The
    payload gains ``ingest_timestamp`` in epoch milliseconds; it comes last, so it replaces an
    earlier member of that name when read. Payloads that are no object are rejected.
    """
    now = F.current_timestamp() if now is None else now
    stamped = (
        computed_once(raw, _members=F.size(members(parse_document(F.col("message")))))
        .withColumn("trace_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
        .withColumn("span_id", F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))
        .withColumn("ingest_timestamp", F.unix_millis(now))
    )
    body = F.trim(F.col("message"))
    payload = F.concat(
        F.substring(body, F.lit(1), F.length(body) - 1),
        F.when(F.col("_members") > 0, F.lit(",")).otherwise(F.lit("")),
        F.lit('"ingest_timestamp":'),
        F.col("ingest_timestamp").cast("string"),
        F.lit("}"),
    )
    ok = F.col("_members") >= 0
    traceparent = F.concat(
        F.lit("00-"), F.col("trace_id"), F.lit("-"), F.col("span_id"), F.lit("-01")
    )
    return (
        stamped.withColumn("traceparent", traceparent)
        .withColumn("value", F.when(ok, _wrapped(F.col("topic"), payload)))
        .withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), F.lit("not_json")))
        .withColumn(
            "headers",
            F.array(
                F.struct(
                    F.lit("traceparent").alias("key"),
                    F.col("traceparent").cast("binary").alias("value"),
                )
            ),
        )
        .drop("_members")
    )


def _doubled(text: Column) -> Column:
    """Whether an object names ``topic`` or ``payload`` twice; most texts are settled by a count."""
    own = F.filter(F.json_object_keys(text), lambda key: key.isin("topic", "payload"))
    maybe = (F.regexp_count(text, F.lit('"(topic|payload)"')) > 2) | F.contains(text, F.lit("\\u"))
    return F.coalesce(maybe & (F.size(own) > 2), F.lit(False))


def decode_envelope(messages: DataFrame) -> DataFrame:
    """Open the envelope in ``value``.

    Adds ``source_topic, topic, payload, document, traceparent, skip_reason``. The message's own
    topic is the stream it came from; the device topic inside the envelope replaces it, and the
    former stays as ``source_topic``. ``payload`` is the raw text of a payload that is a JSON
    string, and for any other payload its compact JSON text with numbers spelled as received;
    ``document`` is its parsed form. Rows that are no envelope, or name topic or payload twice, keep
    NULL topic and payload and a ``skip_reason``; they are counted, not sent to the dead letters.
    """
    text = F.col("value").cast("string")
    opened = computed_once(
        messages.withColumn("_text", text),
        _e=named_members(parse_document(F.col("_text")), ["topic", "payload"]),
    )
    # the type of an object names all its members, so it is worked out once
    opened = computed_once(
        opened.withColumn("_payload", F.col("_e.payload")),
        _topic=as_text(F.col("_e.topic")),
        _kind=json_type(F.col("_e.payload")),
    )
    opened = opened.withColumn("_inner", as_text(F.col("_payload"), F.col("_kind")))
    ok = F.col("_topic").isNotNull() & F.col("_payload").isNotNull() & ~_doubled(F.col("_text"))
    payload = F.when(F.col("_kind") == "VOID", F.lit("null")).otherwise(
        F.get_json_object("_text", "$.payload")
    )
    text_document = F.when(F.col("_inner").isNotNull(), parse_document(F.col("_inner")))
    document = F.when(F.col("_kind") == "STRING", text_document).otherwise(F.col("_payload"))
    keep = [c for c in messages.columns if c not in ("value", "topic", "headers", "key")]
    traceparent = (
        header_text(F.col("headers"), "traceparent")
        if "headers" in messages.columns
        else F.lit(None).cast("string")
    )
    source = [F.col("topic").alias("source_topic")] if "topic" in messages.columns else []
    return opened.withColumn("_ok", ok).select(
        *keep,
        *source,
        F.when(F.col("_ok"), F.col("_topic")).alias("topic"),
        F.when(F.col("_ok"), payload).alias("payload"),
        F.when(F.col("_ok"), document).alias("document"),
        traceparent.alias("traceparent"),
        F.when(~F.col("_ok"), F.lit("not_an_envelope")).alias("skip_reason"),
    )


def skipped_messages(decoded: DataFrame) -> DataFrame:
    """Count of rows that were no envelope, by reason."""
    return (
        decoded.where(F.col("skip_reason").isNotNull())
        .groupBy(F.col("skip_reason").alias("reason"))
        .agg(F.count("*").alias("n"))
    )
