"""Dead-letter records: writing failed messages and playing them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.parse import error_class


def to_dead_letter(
    rejected: DataFrame, at: Column | None = None, carry: list[Column] | None = None
) -> DataFrame:
    """Failed rows as ``key, value`` records, keyed by the original topic.

    ``value`` is JSON with original_topic, error, timestamp (ISO-8601 UTC) and payload_base64;
    ``carry`` names columns to keep beside it.
    """
    at = F.current_timestamp() if at is None else at
    # Spark may break base64 into lines.
    encoded = F.replace(F.base64(F.encode("payload", "UTF-8")), F.lit("\r\n"), F.lit(""))
    record = F.struct(
        F.col("topic").alias("original_topic"),
        F.col("error"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        encoded.alias("payload_base64"),
    )
    return rejected.select(F.col("topic").alias("key"), F.to_json(record).alias("value"), *(carry or []))


def replay_dead_letter(records: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Dead-letter records back to ``topic, payload``, ready to be parsed again; ``carry`` columns stay."""
    fields = F.from_json(
        F.col("value").cast("string"),
        "original_topic string, error string, timestamp string, payload_base64 string",
    )
    return records.select(fields.alias("r"), *(carry or [])).select(
        F.col("r.original_topic").alias("topic"),
        F.decode(F.unbase64("r.payload_base64"), "UTF-8").alias("payload"),
        F.lit(None).cast("string").alias("skip_reason"),
        *(carry or []),
    )


def errors_by_type(rejected: DataFrame) -> DataFrame:
    """Failed rows counted by reason."""
    return rejected.groupBy(error_class(F.col("error")).alias("reason")).agg(
        F.count("*").alias("n")
    )
