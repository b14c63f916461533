"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import topics
from pulsegrid.functions.rules import rule_value as value_of
from pulsegrid.operators import access, alerts, control, dead_letter, metrics, parse, rules
from pulsegrid.operators import envelope, storing, traces
from pulsegrid.plans import fixtures as fx
from pulsegrid.schemas import ALERT_KEYS
from pulsegrid.session import fresh_folder
from pulsegrid.sources import compaction
from pulsegrid.sources.files import Files
from pulsegrid.sources.messages import file_source
from pulsegrid.sources.tables import read_batches, read_readings, read_telemetry
from pulsegrid.streaming import keyed, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, so that results do not depend on the reader's time zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


# Messages and envelopes


@query
def match_topic_filter(spark, sf_dir):
    rows = fx.access_log(spark, sf_dir)
    topic = F.col("topic")
    return rows.select(
        "event_id",
        topics.match_topic_filter(topic, "users/+/devices/+/telemetry").alias("telemetry"),
        topics.match_topic_filter(topic, "users/+/config").alias("config"),
        topics.match_topic_filter(topic, "users/user_1/#").alias("user_1"),
    )


@query
def bridge_wrap(spark, sf_dir):
    wrapped = envelope.bridge_wrap(fx.raw_messages(spark, sf_dir))
    return wrapped.select(
        "event_id",
        "error",
        F.get_json_object("value", "$.topic").alias("topic"),
        F.get_json_object("value", "$.payload.time").alias("time"),
        F.get_json_object("value", "$.payload.temperature").cast("double").alias("temperature"),
    )


@query
def bridge_wrap_enriched(spark, sf_dir):
    return envelope.bridge_wrap_enriched(fx.raw_messages(spark, sf_dir)).drop("headers")


@query
def bridge_wrap_enriched_fields(spark, sf_dir):
    wrapped = envelope.bridge_wrap_enriched(fx.raw_messages(spark, sf_dir), now=F.col("ts"))
    return wrapped.select(
        "event_id",
        "error",
        F.get_json_object("value", "$.topic").alias("topic"),
        F.get_json_object("value", "$.payload.k").cast("double").alias("k"),
        F.unix_millis("ts").alias("sent_ms"),
        F.length("trace_id").alias("trace_digits"),
        F.length("traceparent").alias("context_length"),
    )


@query
def to_otlp_spans(spark, sf_dir):
    wrapped = envelope.bridge_wrap_enriched(fx.raw_messages(spark, sf_dir))
    return traces.to_otlp_spans(wrapped.where(F.col("error").isNull()))


@query
def to_otlp_spans_fields(spark, sf_dir):
    rows = fx.decoded(spark, sf_dir).where(F.col("skip_reason").isNull())
    traced = traces.extract_traceparent(rows).where(F.col("trace_id").isNotNull())
    spans = traces.to_otlp_spans(traced, start=F.col("timestamp"))
    span = "$.resourceSpans[0].scopeSpans[0].spans[0]"

    def field(path):
        return F.get_json_object("message", f"{span}.{path}")

    return spans.select(
        field("traceId").alias("trace_id"),
        field("spanId").alias("span_id"),
        field("name").alias("name"),
        field("kind").cast("bigint").alias("kind"),
        field("startTimeUnixNano").cast("bigint").alias("start_ns"),
        field("endTimeUnixNano").cast("bigint").alias("end_ns"),
        field("attributes[0].value.stringValue").alias("topic"),
    )


@query
def decode_envelope(spark, sf_dir):
    return fx.decoded(spark, sf_dir).select(
        "partition", "offset", "source_topic", "topic", "payload", "skip_reason"
    )


@query
def skipped_messages(spark, sf_dir):
    return envelope.skipped_messages(fx.decoded(spark, sf_dir))


@query
def extract_traceparent(spark, sf_dir):
    traced = traces.extract_traceparent(fx.decoded(spark, sf_dir))
    return traced.select("partition", "offset", "trace_id", "span_id", "flags")


def _batched(spark, sf_dir):
    return fx.accepted(spark, sf_dir).withColumn(
        "batch_id", F.floor(F.col("sequence_id") / 1000).cast("bigint")
    )


@query
def batch_links(spark, sf_dir):
    return traces.batch_links(_batched(spark, sf_dir))


@query
def batch_summary(spark, sf_dir):
    return traces.batch_summary(_batched(spark, sf_dir))


@query
def find_message(spark, sf_dir):
    return parse.find_message(fx.accepted(spark, sf_dir), "click", 1).select(
        "user_id", "device_id", "sequence_id", "temperature"
    )


# Parsing


@query
def parse_telemetry(spark, sf_dir):
    rows = fx.readings(spark, sf_dir)
    return rows.select(
        "partition",
        "offset",
        "user_id",
        "time",
        "device_id",
        F.col("sequence_id").cast("double").alias("sequence_id"),
        "temperature",
        F.col("battery").cast("double").alias("battery"),
        parse.error_class(F.col("error")).alias("error"),
    )


@query
def collect_extras(spark, sf_dir):
    rows = fx.accepted(spark, sf_dir)
    return rows.select("sequence_id", "extra_data")


@query
def valid_device(spark, sf_dir):
    rows = fx.readings(spark, sf_dir)
    return rows.where(F.col("error") == "Empty device_id").select(
        "user_id", "sequence_id", "error"
    )


@query
def user_id_from_topic(spark, sf_dir):
    rows = parse.stamp_user(
        fx.access_log(spark, sf_dir).withColumn(
            "topic",
            F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("a/b/"), "topic"))
            .when(F.col("event_id") % 4 == 1, F.concat("topic", F.lit("/users")))
            .when(F.col("event_id") % 4 == 2, F.concat(F.lit("x/"), "topic"))
            .otherwise(F.col("topic")),
        )
    )
    return rows.select("event_id", "user_id", "rule_user")


@query
def rule_value(spark, sf_dir):
    rows = fx.accepted(spark, sf_dir)
    return rows.select(
        "sequence_id",
        *[
            value_of(F.lit(key), F.col("extras")).alias(f"value_{key}")
            for key in ("temperature", "battery", "k", "device_id")
        ],
    )


@query
def split_accept_reject(spark, sf_dir):
    good, bad = parse.split_accept_reject(fx.readings(spark, sf_dir))
    return good.select(F.lit("accepted").alias("side"), "partition", "offset").unionByName(
        bad.select(F.lit("rejected").alias("side"), "partition", "offset")
    )


@query
def range_validate(spark, sf_dir):
    marked = parse.range_validate(
        fx.readings(spark, sf_dir), {"temperature": (-50.0, 150.0), "battery": (10, 90)}
    )
    return marked.groupBy(F.coalesce(parse.error_class(F.col("error")), F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("n")
    )


@query
def custom_predicates(spark, sf_dir):
    """Another domain: orders as deliveries with a status, watched by customer price limits."""
    orders = fx.table(spark, sf_dir, "orders")
    customers = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("price_floor")
    )
    messages = orders.select(
        "o_custkey",
        F.lit(None).cast("string").alias("skip_reason"),
        fx.delivery_payload().alias("payload"),
    )
    rows = parse.parse_readings(messages, fx.DELIVERY).where(F.col("error").isNull())
    # both sides grow with the tables, and the estimated size of parsed rows is far below the real one
    watched = rows.join(customers.hint("merge"), "o_custkey")
    return parse.matching_alerts(
        watched,
        {
            "DeliveryDelay": (
                "status = 'F'",
                "concat('Package ', package_id, ' is delayed')",
                "NULL",
            ),
            "PriceCrash": ("price < price_floor * 10", "concat(package_id, ' dropped')", "price"),
        },
    ).select("package_id", "time", "alert_type", "message", "value")


# Dead letters


@query
def to_dlq(spark, sf_dir):
    records = dead_letter.to_dead_letter(fx.rejected(spark, sf_dir))
    return records.select(
        "key",
        F.get_json_object("value", "$.original_topic").alias("original_topic"),
        F.get_json_object("value", "$.payload_base64").alias("payload_base64"),
        parse.error_class(F.get_json_object("value", "$.error")).alias("error"),
    )


@query
def replay_dlq(spark, sf_dir):
    records = dead_letter.to_dead_letter(fx.rejected(spark, sf_dir))
    again = parse.parse_telemetry(dead_letter.replay_dead_letter(records))
    return again.select("topic", "payload", parse.error_class(F.col("error")).alias("error"))


@query
def errors_by_type(spark, sf_dir):
    return dead_letter.errors_by_type(fx.rejected(spark, sf_dir))


@query
def message_counts(spark, sf_dir):
    decoded = fx.decoded(spark, sf_dir)
    return metrics.message_counts(decoded, parse.parse_telemetry(decoded))


# Control messages and rules


@fx.plan_once
def _routed(spark, sf_dir):
    return control.route_control(fx.control_messages(spark, sf_dir))


@query
def route_control(spark, sf_dir):
    telemetry = fx.raw_messages(spark, sf_dir).select("topic", F.col("message").alias("payload"))
    both = fx.control_messages(spark, sf_dir).select("topic", "payload").unionByName(telemetry)
    return control.route_control(both).groupBy("route").agg(F.count("*").alias("n"))


@query
def parse_config_update(spark, sf_dir):
    parsed = control.parse_config_update(_routed(spark, sf_dir))
    return parsed.select(
        "topic",
        "sequence_id",
        "user_id",
        F.size("rules").cast("double").alias("n_rules"),
        F.get("rules", F.lit(0))["key"].alias("first_key"),
        F.get("rules", F.lit(0))["threshold"].alias("first_threshold"),
        "error",
    )


@query
def parse_command(spark, sf_dir):
    parsed = control.parse_command(_routed(spark, sf_dir))
    return parsed.select(
        "sequence_id", "user_id", "device_id", "rule_id", "action", "duration_minutes", "error"
    )


@fx.plan_once
def config_changes(spark, sf_dir) -> DataFrame:
    """Valid rule updates: ``user_id, rules, time, sequence_id``."""
    parsed = control.parse_config_update(_routed(spark, sf_dir))
    return parsed.where(F.col("error").isNull()).select(
        "user_id", "rules", F.col("ts").alias("time"), "sequence_id"
    )


@fx.plan_once
def commands(spark, sf_dir) -> DataFrame:
    """Valid alert commands with ``time`` and ``sequence_id``."""
    parsed = control.parse_command(_routed(spark, sf_dir))
    return parsed.where(F.col("error").isNull()).select(
        *ALERT_KEYS, "action", "duration_minutes", F.col("ts").alias("time"), "sequence_id"
    )


@fx.plan_once
def first_configs(spark, sf_dir) -> DataFrame:
    """The first stored rules per user, before any change."""
    return config_changes(spark, sf_dir).where(F.col("sequence_id") == 0).select("user_id", "rules")


@fx.plan_once
def evaluations(spark, sf_dir) -> DataFrame:
    """All rules evaluated on all accepted readings, with the first stored rules."""
    ruled = rules.rules_for_user(fx.accepted(spark, sf_dir), first_configs(spark, sf_dir))
    return rules.evaluate_rules(ruled)


@query
def load_rules(spark, sf_dir):
    stored = fx.config_messages(spark, sf_dir).where(F.col("topic").endswith("/config")).select(
        F.split("topic", "/")[1].alias("user_id"),
        "sequence_id",
        F.get_json_object("payload", "$.rules").alias("rules"),
    )
    return rules.load_rules(stored).select(
        "user_id", "sequence_id", F.size("rules").cast("bigint").alias("n_rules")
    )


@query
def upsert_config(spark, sf_dir):
    changes = config_changes(spark, sf_dir)
    stored = first_configs(spark, sf_dir)
    newest = rules.upsert_config(
        stored, changes.where(F.col("sequence_id") > 0), ["time", "sequence_id"]
    )
    return newest.select(
        "user_id",
        F.size("rules").cast("bigint").alias("n_rules"),
        F.get("rules", F.lit(0))["threshold"].alias("first_threshold"),
    )


@query
def rules_for_user(spark, sf_dir):
    ruled = rules.rules_for_user(fx.accepted(spark, sf_dir), first_configs(spark, sf_dir))
    return ruled.select(
        "sequence_id",
        "user_id",
        F.size("rules").cast("bigint").alias("n_rules"),
        F.get("rules", F.lit(0))["threshold"].alias("first_threshold"),
    )


@query
def rules_as_of(spark, sf_dir):
    ruled = rules.rules_as_of(fx.accepted(spark, sf_dir), config_changes(spark, sf_dir))
    return ruled.select(
        "sequence_id",
        "user_id",
        F.size("rules").cast("bigint").alias("n_rules"),
        F.get("rules", F.lit(0))["threshold"].alias("first_threshold"),
    )


@query
def rules_as_of_hot_user(spark, sf_dir):
    ruled = rules.rules_as_of(*fx.hot_rules(spark, sf_dir))
    threshold = F.get("rules", F.lit(0))["threshold"].alias("threshold")
    return ruled.select("sequence_id", F.col("rule_user").alias("user_id"), threshold)


@query
def explode_rules(spark, sf_dir):
    ruled = rules.rules_for_user(fx.accepted(spark, sf_dir), first_configs(spark, sf_dir))
    return rules.explode_rules(ruled).select(
        "sequence_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("rule.key").alias("rule_key"),
        F.col("rule.operator").alias("operator"),
        F.col("rule.threshold").alias("threshold"),
    )


@query
def eval_rule(spark, sf_dir):
    return evaluations(spark, sf_dir).select(
        "user_id",
        "device_id",
        "rule_id",
        F.col("pos").cast("bigint").alias("pos"),
        "time",
        "sequence_id",
        "value",
        "message",
        "triggered",
    )


# Alerts


@query
def alert_transitions(spark, sf_dir):
    return alerts.alert_transitions(evaluations(spark, sf_dir))


@query
def alert_transitions_hot_key(spark, sf_dir):
    # line items of one number and day differ by quantity
    return alerts.alert_transitions(fx.hot_evaluations(spark, sf_dir), ["time", "sequence_id", "value"])


@query
def alert_transitions_dynamic_rules(spark, sf_dir):
    ruled = rules.rules_as_of(fx.accepted(spark, sf_dir), config_changes(spark, sf_dir))
    return alerts.alert_transitions(rules.evaluate_rules(ruled))


@query
def active_alerts_asof(spark, sf_dir):
    return alerts.active_alerts_asof(evaluations(spark, sf_dir))


@query
def active_alerts_midway(spark, sf_dir):
    midway = F.lit(fx.CHANGE_AT).cast("timestamp")
    return alerts.active_alerts_asof(evaluations(spark, sf_dir), as_of=midway)


@query
def make_alert(spark, sf_dir):
    changes = evaluations(spark, sf_dir).withColumn(
        "status", F.when(F.col("triggered"), "Triggered").otherwise("Resolved")
    )
    return alerts.make_alert(changes)


@query
def publish_alerts(spark, sf_dir):
    published = alerts.publish_alerts(alerts.alert_transitions(evaluations(spark, sf_dir)))
    return published.select(
        "topic",
        F.get_json_object("value", "$.device_id").alias("device_id"),
        F.get_json_object("value", "$.alert_type").alias("alert_type"),
        F.get_json_object("value", "$.status").alias("status"),
        F.get_json_object("value", "$.value").cast("double").alias("value"),
    )


def _followed(spark, sf_dir):
    return alerts.follow_alerts(evaluations(spark, sf_dir), commands(spark, sf_dir))


@query
def alert_history_with_commands(spark, sf_dir):
    return alerts.alert_history_with_commands(
        evaluations(spark, sf_dir), commands(spark, sf_dir)
    )


@query
def active_alerts_with_commands(spark, sf_dir):
    return alerts.alert_state_after(_followed(spark, sf_dir))


@query
def alerts_by_rule_user(spark, sf_dir):
    return metrics.alerts_by_rule_user(alerts.alert_transitions(evaluations(spark, sf_dir)))


@query
def alerts_per_minute(spark, sf_dir):
    return metrics.alerts_per_minute(alerts.alert_transitions(evaluations(spark, sf_dir)))


# Storing


@fx.plan_once
def _offered(spark, sf_dir):
    rows = fx.with_copies(fx.accepted(spark, sf_dir))
    return rows.select(*storing.STORED, *storing.ARRIVAL)


def _stored(spark, sf_dir):
    """What an earlier run has stored: the first half of the month."""
    rows = fx.accepted(spark, sf_dir).where(F.col("time") < F.lit(fx.CHANGE_AT).cast("timestamp"))
    return rows.select(*storing.STORED)


@query
def dedupe_first_wins(spark, sf_dir):
    return storing.dedupe_first_wins(_offered(spark, sf_dir)).select(
        "time", "user_id", "device_id", "sequence_id", "temperature", "battery"
    )


@query
def anti_join_existing(spark, sf_dir):
    offered = storing.dedupe_first_wins(_offered(spark, sf_dir))
    return storing.anti_join_existing(offered, _stored(spark, sf_dir)).select(
        "time", "user_id", "device_id", "sequence_id", "temperature", "battery"
    )


@query
def write_stats(spark, sf_dir):
    offered = _offered(spark, sf_dir).withColumn("batch_id", F.col("sequence_id") % 7)
    return storing.write_stats(offered, _stored(spark, sf_dir))


@query
def quarantine_split(spark, sf_dir):
    good, bad = storing.quarantine_split(fx.readings(spark, sf_dir))
    reason = parse.error_class(F.col("error")).alias("reason")
    counted = bad.groupBy(reason).agg(F.count("*").alias("n"))
    return counted.unionByName(good.agg(F.lit("stored").alias("reason"), F.count("*").alias("n")))


# Operational analytics


@fx.plan_once
def _arrived(spark, sf_dir):
    rows = fx.decoded(spark, sf_dir).where(F.col("skip_reason").isNull())
    return rows.select("topic", F.col("timestamp").alias("ts"))


@query
def messages_by_topic(spark, sf_dir):
    return metrics.messages_by_topic(fx.decoded(spark, sf_dir))


@query
def payload_size_stats(spark, sf_dir):
    stats = traces.payload_size_stats(fx.decoded(spark, sf_dir))
    return stats.select(
        "topic",
        "n",
        F.round("mean", 6).alias("mean"),
        F.round("p50", 6).alias("p50"),
        F.round("p95", 6).alias("p95"),
        F.col("lowest").cast("bigint").alias("lowest"),
        F.col("highest").cast("bigint").alias("highest"),
    )


@query
def ingress_latency(spark, sf_dir):
    rows = fx.accepted(spark, sf_dir)
    sent = F.try_variant_get(F.try_element_at("extras", F.lit("ingest_timestamp")), "$", "bigint")
    # every third row has no device: NULL is a group like others
    known = F.when(F.col("sequence_id") % 3 != 0, F.col("device_id"))
    rows = rows.withColumn("device_id", known)
    stats = traces.ingress_latency(rows, F.col("timestamp"), sent, ["device_id"])
    return stats.select(
        "device_id",
        "n",
        F.round("mean", 6).alias("mean"),
        F.round("p50", 6).alias("p50"),
        F.round("p95", 6).alias("p95"),
        "lowest",
        "highest",
    )


@query
def message_rate(spark, sf_dir):
    return metrics.message_rate(_arrived(spark, sf_dir))


@query
def message_rate_sliding(spark, sf_dir):
    return metrics.message_rate(_arrived(spark, sf_dir), slide="5 seconds")


@query
def active_topics(spark, sf_dir):
    return metrics.active_topics(_arrived(spark, sf_dir), length="1 hour")


@query
def idle_topics(spark, sf_dir):
    return metrics.idle_topics(_arrived(spark, sf_dir))


@query
def avg_topic_rate(spark, sf_dir):
    return metrics.avg_topic_rate(_arrived(spark, sf_dir), length="1 hour")


@query
def top_topics(spark, sf_dir):
    ranked = metrics.top_topics(_arrived(spark, sf_dir), length="1 day")
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query
def top_topics_overall(spark, sf_dir):
    return metrics.top_topics_overall(_arrived(spark, sf_dir))


@query
def errors_per_minute(spark, sf_dir):
    return metrics.errors_per_minute(
        fx.rejected(spark, sf_dir).withColumnRenamed("timestamp", "ts")
    )


@query
def write_rate(spark, sf_dir):
    stored = storing.dedupe_first_wins(_offered(spark, sf_dir))
    return metrics.write_rate(stored, ts="time", length="1 hour")


def _lag(spark, sf_dir):
    rows = fx.message_rows(spark, sf_dir)
    committed = (
        rows.where(F.col("partition") != 3)
        .groupBy("topic", "partition")
        .agg((F.max("offset") - F.col("partition") * 10).alias("committed"))
    )
    return metrics.consumer_lag(rows, committed)


@query
def consumer_lag(spark, sf_dir):
    return _lag(spark, sf_dir).withColumns(
        {
            "partition": F.col("partition").cast("bigint"),
            "committed": F.col("committed").cast("double"),
        }
    )


@query
def threshold_band(spark, sf_dir):
    steps = [(100, "orange"), (1000, "red")]
    total = _lag(spark, sf_dir).groupBy("topic").agg(F.sum("lag").alias("lag"))
    return total.withColumn("band", metrics.threshold_band(F.col("lag"), steps, "green"))


@query
def counter_rate(spark, sf_dir):
    return metrics.counter_rate(fx.counter_samples(spark, sf_dir), ["series"], "1 hour")


@query
def gauge_last(spark, sf_dir):
    return metrics.gauge_last(fx.counter_samples(spark, sf_dir), ["series"])


@query
def status_map(spark, sf_dir):
    up = fx.access_log(spark, sf_dir).select(
        F.col("username").alias("service"), "event_id"
    )
    samples = up.select(
        "service",
        F.timestamp_seconds(F.col("event_id")).alias("ts"),
        (F.col("event_id") % 3).cast("double").alias("value"),
    )
    return metrics.status_map(metrics.gauge_last(samples, ["service"]))


@query
def acl_audit(spark, sf_dir):
    audited = access.acl_audit(fx.access_log(spark, sf_dir), fx.access_list(spark, sf_dir))
    return audited.select("event_id", "username", "action", "topic", "allowed")


# Streams: the same messages in two deliveries, the second after a restart from the checkpoint


def _everything(spark, sf_dir):
    return fx.message_rows(spark, sf_dir).unionByName(fx.control_rows(spark, sf_dir))


def _delivered(spark, sf_dir, name, start, messages=None, anew=False):
    """Run a live query over all messages, half a month at a time; returns its tables.

    ``anew`` starts the second half with a checkpoint and an inbox of its own.
    """
    folder = fresh_folder(spark, name)
    everything = _everything(spark, sf_dir) if messages is None else messages
    middle = F.lit(fx.CHANGE_AT).cast("timestamp")
    for half, part in enumerate((F.col("timestamp") < middle, F.col("timestamp") >= middle)):
        run = half if anew else 0
        store, inbox = live.Store(f"{folder}/store", f"{folder}/checkpoints-{run}"), f"{folder}/inbox-{run}"
        everything.where(part).write.mode("append").parquet(inbox)
        start(file_source(spark, inbox), store, availableNow=True).awaitTermination()
    return store


@query
def alert_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "alert_stream", live.start_alerts)
    return read_batches(spark, store.history).drop("created_at")


@query
def alert_stream_ties(spark, sf_dir):
    rows = fx.by_minute(_everything(spark, sf_dir))
    store = _delivered(spark, sf_dir, "alert_stream_ties", live.start_alerts, rows)
    return read_batches(spark, store.history).drop("created_at")


@query
def alert_stream_new_checkpoint(spark, sf_dir):
    store = _delivered(spark, sf_dir, "alert_stream_anew", live.start_alerts, anew=True)
    return read_batches(spark, store.history).drop("created_at")


@query
def alert_stream_new_checkpoint_state(spark, sf_dir):
    store = _delivered(spark, sf_dir, "alert_stream_anew_state", live.start_alerts, anew=True)
    return store.active(spark).latest()


@query
def alert_stream_keyed(spark, sf_dir):
    rows = fx.by_minute(_everything(spark, sf_dir))
    store = _delivered(spark, sf_dir, "alert_stream_keyed", keyed.start_keyed_alerts, rows)
    return read_batches(spark, store.history).drop("created_at")


def _keyed_anew(spark, sf_dir, name):
    """The second half starts a checkpoint of its own from the state that the first one left."""
    earlier = []

    def start(messages, store, **trigger):
        seeds = {}
        if earlier:
            seeds = {"configs": keyed.kept_rules(spark, earlier[0]), "active": keyed.kept_alerts(spark, earlier[0])}
        earlier.append(store)
        return keyed.start_keyed_alerts(messages, store, **seeds, **trigger)

    return _delivered(spark, sf_dir, name, start, anew=True)


@query
def alert_stream_keyed_new_checkpoint(spark, sf_dir):
    store = _keyed_anew(spark, sf_dir, "alert_stream_keyed_anew")
    return read_batches(spark, store.history).drop("created_at")


@query
def alert_stream_keyed_state(spark, sf_dir):
    return keyed.kept_alerts(spark, _keyed_anew(spark, sf_dir, "alert_stream_keyed_state"))


@query
def hostile_messages(spark, sf_dir):
    routed = control.route_control(envelope.decode_envelope(fx.hostile_rows(spark, sf_dir)))
    updates = control.parse_config_update(routed).where("error IS NULL").select("user_id", "rules")
    commands = control.parse_command(routed).where("error IS NULL")
    commands = commands.withColumns({"sequence_id": F.col("offset"), "time": F.col("timestamp")})
    readings = parse.parse_telemetry(envelope.decode_envelope(fx.hostile_rows(spark, sf_dir).where(F.col("topic") == fx.STREAM)))
    evaluated = rules.evaluate_rules(rules.rules_for_user(readings.where("error IS NULL"), updates))
    return alerts.alert_history_with_commands(evaluated, commands)


@query
def hostile_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "hostile_stream", live.start_alerts, fx.hostile_rows(spark, sf_dir))
    return read_batches(spark, store.history).drop("created_at")


@query
def hostile_errors(spark, sf_dir):
    store = _delivered(spark, sf_dir, "hostile_errors", live.start_ingest, fx.hostile_rows(spark, sf_dir))
    letters = read_batches(spark, store.dead_letters)
    return letters.groupBy("key").agg(F.count("*").alias("n"))


@query
def decode_envelope_doubled(spark, sf_dir):
    rows = fx.message_rows(spark, sf_dir)
    text = F.col("value").cast("string")
    twice = F.concat(F.lit('{"payload":0,'), F.substring(text, F.lit(2), F.length(text)))
    rows = rows.withColumn("value", F.when(F.col("offset") % 3 == 0, twice).otherwise(text).cast("binary"))
    return envelope.decode_envelope(rows).select("partition", "offset", "topic", "skip_reason")


@query
def alerts_per_minute_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "alerts_per_minute_stream", live.start_alerts)
    return live.read_alerts_per_minute(spark, store)


@query
def errors_per_minute_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "errors_per_minute_stream", live.start_ingest)
    return live.read_errors_per_minute(spark, store, "arrived_at")


@query
def write_stats_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "write_stats_stream", live.start_ingest, _with_late_copies(spark, sf_dir))
    stats = live.read_write_stats(spark, store)
    return stats.agg(*[F.sum(c).alias(c) for c in ("offered", "written", "duplicates")])


def _with_late_copies(spark, sf_dir):
    """All messages, and every tenth offset once more much later."""
    rows = fx.message_rows(spark, sf_dir)
    late = rows.where(F.col("offset") % 10 == 0).withColumns(
        {"offset": F.col("offset") + 1_000_000_000, "timestamp": F.col("timestamp") + F.expr("INTERVAL 20 DAYS")}
    )
    return rows.unionByName(late)


@query
def alert_stream_state(spark, sf_dir):
    store = _delivered(spark, sf_dir, "alert_stream_state", live.start_alerts)
    return store.active(spark).latest()


@query
def stream_ingest(spark, sf_dir):
    store = _delivered(spark, sf_dir, "stream_ingest", live.start_ingest)
    return read_telemetry(spark, store.telemetry).select(
        "time", "user_id", "device_id", "sequence_id", "temperature", "extra_data"
    )


@query
def stream_ingest_compacted(spark, sf_dir):
    """Every day is compacted between the two deliveries; the second brings copies of stored rows."""
    days = []

    def start(messages, store, **trigger):
        if Files(spark, store.telemetry).names(store.telemetry):
            days.extend(n.removeprefix("dt=") for n in Files(spark, store.telemetry).names(store.telemetry) if n.startswith("dt="))
            for day in days:
                compaction.compact_day(spark, store.telemetry, day, file_rows=100)
        return live.start_ingest(messages, store, **trigger)

    store = _delivered(spark, sf_dir, "stream_ingest_compacted", start, _with_late_copies(spark, sf_dir))
    compaction.clean(spark, store.telemetry)
    return read_telemetry(spark, store.telemetry).select(
        "time", "user_id", "device_id", "sequence_id", "temperature", "extra_data"
    )


@query
def stream_ingest_deliveries(spark, sf_dir):
    """Another domain through the same live writer."""

    def start(messages, store, **trigger):
        return live.start_ingest(messages, store, spec=fx.DELIVERY, **trigger)

    store = _delivered(spark, sf_dir, "stream_ingest_deliveries", start, fx.delivery_rows(spark, sf_dir))
    stored = read_readings(spark, store.telemetry, fx.DELIVERY)
    return stored.select("time", "package_id", "status", "price", F.col("dt").cast("string").alias("day"))


@query
def stream_replay(spark, sf_dir):
    """Temperatures sent as text are repaired and played, twice; the other letters fail again."""
    store = _delivered(spark, sf_dir, "stream_replay", live.start_ingest)

    def repair(messages):
        return messages.withColumn("payload", F.regexp_replace("payload", '"temperature":"([^"]*)"', '"temperature":$1'))

    for run in ("first", "second"):
        live.replay_dead_letters(spark, store, run, repair)
    return read_telemetry(spark, store.telemetry).select("time", "user_id", "device_id", "sequence_id", "temperature")


@query
def stream_dead_letters(spark, sf_dir):
    store = _delivered(spark, sf_dir, "stream_dead_letters", live.start_ingest)
    return spark.read.parquet(store.dead_letters).select(
        "key", parse.error_class(F.get_json_object("value", "$.error")).alias("error")
    )


@query
def message_rate_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "message_rate_stream", live.start_message_rate)
    return live.read_message_rate(spark, store)


@query
def active_topics_stream(spark, sf_dir):
    def start(messages, store, **trigger):
        return live.start_complete_windows(messages, store, "active_topics", "1 hour", **trigger)

    store = _delivered(spark, sf_dir, "active_topics_stream", start)
    return read_batches(spark, store.measure("active_topics"))


@query
def top_topics_stream(spark, sf_dir):
    def start(messages, store, **trigger):
        return live.start_top_topics(messages, store, length="1 day", **trigger)

    store = _delivered(spark, sf_dir, "top_topics_stream", start)
    rows = read_batches(spark, store.measure("top_topics"))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query
def idle_topics_stream(spark, sf_dir):
    store = _delivered(spark, sf_dir, "idle_topics_stream", live.start_idle_topics)
    return read_batches(spark, store.measure("idle_topics"))


@query
def consumer_lag_stream(spark, sf_dir):
    """The second half of the month has come in, and a live query has read the first."""
    rows = fx.message_rows(spark, sf_dir)
    first = rows.where(F.col("timestamp") < F.lit(fx.CHANGE_AT).cast("timestamp"))
    store = _delivered(spark, sf_dir, "consumer_lag_stream", live.start_offsets, first)
    return live.read_consumer_lag(spark, store, rows)


@query
def stream_ingest_bounded(spark, sf_dir):
    """Every tenth message comes again two minutes later, some of the first half twenty days later."""
    rows = fx.message_rows(spark, sf_dir)

    def again(part, after, shift):
        later = F.col("timestamp") + F.expr(f"INTERVAL {after}")
        return rows.where(part).withColumns({"offset": F.col("offset") + shift, "timestamp": later})

    early = F.col("timestamp") < F.lit(fx.CHANGE_AT).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    near = again(F.col("offset") % 10 == 0, "2 MINUTES", 1_000_000_000)
    far = again((F.col("offset") % 15 == 0) & early, "20 DAYS", 2_000_000_000)
    messages = rows.unionByName(near).unionByName(far)
    store = _delivered(spark, sf_dir, "stream_ingest_bounded", live.start_bounded_ingest, messages)
    return read_batches(spark, store.bounded).select("time", "user_id", "device_id", "sequence_id", "temperature")


@query
def late_messages_stream(spark, sf_dir):
    """Every tenth message of the first half of the month comes after all others."""
    folder, rows = fresh_folder(spark, "late_messages"), fx.message_rows(spark, sf_dir)
    held_back = (F.col("offset") % 10 == 0) & (F.col("timestamp") < F.lit(fx.CHANGE_AT).cast("timestamp"))
    store = live.Store(f"{folder}/store")
    for part in (~held_back, held_back):
        rows.where(part).write.mode("append").parquet(f"{folder}/inbox")
        live.start_late_messages(file_source(spark, f"{folder}/inbox"), store, availableNow=True).awaitTermination()
    return live.read_late_messages(spark, store)
