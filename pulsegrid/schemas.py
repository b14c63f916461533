"""Schemas of the data model, and the description of a reading that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MESSAGE_ROW = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]
                )
            ),
        ),
    ]
)

RULE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("message", T.StringType()),
    ]
)
RULES = T.ArrayType(RULE)

ALERT = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

ACTIVE_ALERT = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("snooze_until", T.TimestampType()),
        T.StructField("current_value", T.DoubleType()),
    ]
)

ALERT_KEYS = ["user_id", "device_id", "rule_id"]

# The rule every user without a stored configuration gets.
DEFAULT_RULE = {
    "key": "temperature",
    "operator": ">",
    "threshold": 80.0,
    "message": "High Temperature Alert (Default Rule)",
}


KINDS = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class Field:
    """One typed payload field. ``kind`` is string, long, int, double or timestamp."""

    name: str
    kind: str
    required: bool = False
    non_empty: bool = False


@dataclass(frozen=True)
class DomainSpec:
    """What one reading looks like: typed fields, row key, time column and message topic."""

    fields: tuple[Field, ...]
    key: tuple[str, ...]
    time: str
    topic_filter: str

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def stored(self) -> list[str]:
        """Columns of a stored reading: the key, the other fields, and what no field names."""
        return [*self.key, *[n for n in self.names if n not in self.key], "extra_data"]

    @property
    def table(self) -> T.StructType:
        """Schema of the stored readings; the date of their time is the partition."""
        kinds = {f.name: KINDS[f.kind] for f in self.fields}
        fields = [T.StructField(n, kinds.get(n, T.StringType())) for n in self.stored]
        return T.StructType([*fields, T.StructField("dt", T.DateType())])


TELEMETRY = DomainSpec(
    fields=(
        Field("time", "timestamp", required=True),
        Field("device_id", "string", required=True, non_empty=True),
        Field("sequence_id", "long", required=True),
        Field("temperature", "double"),
        Field("battery", "int"),
    ),
    key=("time", "user_id", "device_id", "sequence_id"),
    time="time",
    topic_filter="users/+/devices/+/telemetry",
)
