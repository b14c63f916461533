"""Live queries: storing readings, following alerts, counting messages.

Every query is a ``foreachBatch`` over a stream of message rows, made of the batch operators, so a
stream gives what a batch over the same messages gives. All outputs are keyed by query and batch
or by the row key: a micro-batch repeated after a lost executor or a restart changes nothing, and a
query with a new checkpoint goes on from the state it finds and adds to the outputs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pulsegrid.functions.topics import control_route, match_topic_filter, user_id_from_topic
from pulsegrid.operators import alerts, control, dead_letter, metrics, parse, rules, storing
from pulsegrid.operators.envelope import decode_envelope, skipped_messages
from pulsegrid.schemas import ACTIVE_ALERT, ALERT_KEYS, RULES, TELEMETRY, DomainSpec
from pulsegrid.session import configure, drop_folder
from pulsegrid.sources.tables import (
    BATCH_COLUMNS,
    Snapshots,
    append_batch,
    query_id,
    read_measure,
    write_readings,
    write_telemetry,
)

TOPICS = T.StructType([T.StructField("topic", T.StringType()), T.StructField("first_seen", T.TimestampType())])
CONFIGS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("rules", RULES)])


@dataclass(frozen=True)
class Store:
    """Where the live queries keep their tables, all below one shared folder.

    ``checkpoints`` may place the checkpoints of the queries elsewhere, to start anew on old tables.
    """

    root: str
    checkpoints: str | None = None

    @property
    def telemetry(self) -> str:
        return f"{self.root}/raw_telemetry"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def writes(self) -> str:
        return f"{self.root}/writes"

    @property
    def skipped(self) -> str:
        return f"{self.root}/skipped"

    @property
    def history(self) -> str:
        return f"{self.root}/alerts_history"

    @property
    def ledger(self) -> str:
        return f"{self.root}/replayed_letters"

    @property
    def bounded(self) -> str:
        return f"{self.root}/bounded_telemetry"

    def topics(self, spark: SparkSession) -> Snapshots:
        return Snapshots(spark, f"{self.root}/topics", TOPICS, ["topic"])

    def measure(self, name: str) -> str:
        return f"{self.root}/measures/{name}"

    def configs(self, spark: SparkSession) -> Snapshots:
        return Snapshots(spark, f"{self.root}/user_configs", CONFIGS, ["user_id"])

    def active(self, spark: SparkSession) -> Snapshots:
        return Snapshots(spark, f"{self.root}/active_alerts", ACTIVE_ALERT, ALERT_KEYS)

    def seed(self, configs: DataFrame | None = None, active: DataFrame | None = None) -> None:
        """Take over existing tables before the first start: ``user_id, rules`` and active alerts."""
        if configs is not None:
            self.configs(configs.sparkSession).seed(configs)
        if active is not None:
            self.active(active.sparkSession).seed(active)

    def scratch(self, query: str, batch_id: int) -> str:
        return f"{self.root}/scratch/{query}-{batch_id}"

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints or self.root + '/checkpoints'}/{name}"


def start(
    stream: DataFrame,
    batch: Callable[[DataFrame, str, int], None],
    checkpoint: str,
    trigger: dict,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``batch`` with the rows, the query's id and the batch number."""

    def run(rows: DataFrame, batch_id: int) -> None:
        batch(rows, query_id(rows.sparkSession, checkpoint), batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_ingest(
    messages: DataFrame,
    store: Store,
    bounds: dict | None = None,
    send_failed: Callable[[DataFrame], None] | None = None,
    spec: DomainSpec | None = None,
    **trigger,
) -> StreamingQuery:
    """Store valid readings once, failed ones as dead letters, and count what was skipped.

    Without ``spec`` these are telemetry, on all topics but those of control messages. A ``spec`` takes
    the messages on its own topics, keyed, timed and typed as it says; each domain has a store of its own.
    ``bounds`` adds range checks. ``send_failed`` also gets the dead letters of each batch, say to
    write them to a Kafka topic; it may see them again if the batch is repeated. The trigger is
    ``availableNow=True`` or ``processingTime=...``.
    """
    configure(messages.sparkSession)

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        configure(rows.sparkSession)
        decoded = decode_envelope(rows)
        kind = spec or TELEMETRY
        skipped, topic = F.col("skip_reason").isNotNull(), F.col("topic")
        own = control_route(topic).isNull() if spec is None else match_topic_filter(topic, spec.topic_filter)
        # what was skipped is kept beside the readings, so that every message is opened once
        readings = parse.stamp_user(parse.parse_readings(decoded.where(skipped | own), kind))
        readings = readings.drop("document", "extras")
        if bounds:
            readings = parse.range_validate(readings, bounds)
        with _kept(readings) as kept:
            readings = kept.where(~skipped)
            good, bad = storing.quarantine_split(readings, list(kind.key))
            counts = write_readings(good, store.telemetry, kind)
            counted = rows.sparkSession.createDataFrame([counts], "offered long, written long")
            append_batch(counted, store.writes, query, batch_id)
            letters = dead_letter.to_dead_letter(bad)
            arrived = dead_letter.to_dead_letter(bad, carry=[F.col("timestamp").alias("arrived_at")])
            append_batch(arrived, store.dead_letters, query, batch_id)
            if send_failed is not None:
                send_failed(letters)
            append_batch(skipped_messages(kept), store.skipped, query, batch_id)

    return start(messages, batch, store.checkpoint("ingest"), trigger)


def start_bounded_ingest(messages: DataFrame, store: Store, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Store valid readings without looking at what is stored: keys are remembered for ``delay`` only.

    The keys of the last ``delay`` (by arrival) lie in the streaming state. A copy that arrives within
    ``delay`` of the first is dropped, one that arrives after the state has forgotten the key is stored
    again, and which of several copies in one micro-batch stays is not said. State and cost do not grow
    with the table. Failed messages are ``start_ingest``'s business.
    """
    configure(messages.sparkSession)
    decoded = decode_envelope(messages)
    telemetry = decoded.where(F.col("skip_reason").isNull() & control_route(F.col("topic")).isNull())
    readings = parse.parse_telemetry(telemetry).drop("document", "extras")
    good, _ = storing.quarantine_split(readings)
    fresh = good.select("timestamp", *storing.STORED).withWatermark("timestamp", delay)
    fresh = fresh.dropDuplicatesWithinWatermark(storing.KEY)

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        append_batch(rows, store.bounded, query, batch_id)

    return start(fresh, batch, store.checkpoint("bounded_ingest"), trigger)


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep rows that several outputs share; a lost copy is computed again from the source."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def _scratch(store: Store, query: str, batch_id: int) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Write tables of one micro-batch and read them back; they are removed when it is done.

    Several steps read these tables. Spark plans every read of cached rows as a stage of its own, so it does
    not see that shuffles above a cache are equal and makes them once per reader; above files it does. A
    repeated micro-batch replaces what the failed one left.
    """
    folder = store.scratch(query, batch_id)
    used = []

    def written(rows: DataFrame, name: str) -> DataFrame:
        used.append(rows.sparkSession)
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    try:
        yield written
    finally:
        if used:
            drop_folder(used[0], folder)


#: Where a message stands among those of its timestamp.
SEQUENCE = "struct<source_topic:string,partition:int,offset:bigint>"


def arrival(rows: DataFrame) -> DataFrame:
    place = F.struct("source_topic", "partition", "offset").cast(SEQUENCE)
    return rows.withColumn("sequence_id", place)


def start_alerts(
    messages: DataFrame,
    store: Store,
    publish: Callable[[DataFrame], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Follow alerts over a stream of telemetry, rule updates and commands.

    Messages count in order of arrival (timestamp, then source topic, partition and offset); a rule
    update holds for later messages, and a snooze runs out by arrival time. The rules and the active
    alerts are snapshots of which each micro-batch reads and renews the buckets it touches, so
    neither a device nor a user with most of the messages ends up in one task. ``publish`` gets the alert messages of a batch and may see them
    again if the batch is repeated.
    """
    spark = configure(messages.sparkSession)
    configs, active = store.configs(spark), store.active(spark)

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        configure(rows.sparkSession)
        decoded = arrival(decode_envelope(rows).withColumn("route", control_route(F.col("topic"))))
        with _kept(decoded) as decoded, _scratch(store, query, batch_id) as written:
            rules_base, alerts_base = configs.before(query, batch_id), active.before(query, batch_id)
            known_rules = configs.read(rules_base)
            updates = control.parse_config_update(decoded).where(F.col("error").isNull())
            updates = written(updates.select("user_id", "rules", "timestamp", "sequence_id"), "updates")
            changed = configs.touched(updates)
            commands = control.parse_command(decoded).where(F.col("error").isNull())
            commands = written(
                commands.select(*ALERT_KEYS, "timestamp", "sequence_id", "action", "duration_minutes"), "commands"
            )
            telemetry = decoded.where(F.col("route").isNull()).withColumnRenamed("sequence_id", "place")
            readings = parse.parse_telemetry(telemetry).where(F.col("error").isNull()).select(
                "rule_user",
                "user_id",
                "device_id",
                "time",
                "temperature",
                "battery",
                "extras",
                "timestamp",
                F.col("place").alias("sequence_id"),
            )
            if changed:
                changes = written(_changes_in_batch(telemetry, known_rules, updates), "changes")
                ruled = rules.rules_as_of(readings, changes, at="timestamp", arrival=True)
            else:
                ruled = rules.rules_for_user(readings, known_rules)
            evaluated = written(rules.evaluate_rules(ruled, carry=("timestamp",)), "evaluated")
            keys = evaluated.select(*ALERT_KEYS).unionByName(commands.select(*ALERT_KEYS))
            keys = keys.distinct()
            buckets = active.touched(keys)
            known_alerts = active.read(alerts_base, buckets)
            followed = alerts.follow_alerts(
                evaluated,
                commands,
                known_alerts.join(keys, ALERT_KEYS, "left_semi"),
                clock="timestamp",
                order=alerts.ARRIVAL_ORDER,
            )
            followed = written(followed, "followed")
            history = alerts.make_alert(followed.where(F.col("status").isNotNull()))
            history = history.withColumn("created_at", F.current_timestamp())
            append_batch(history, store.history, query, batch_id)
            if publish is not None:
                publish(alerts.publish_alerts(history))
            after = alerts.alert_state_after(followed).unionByName(
                known_alerts.join(keys, ALERT_KEYS, "left_anti")
            )
            if buckets:
                active.write(after, alerts_base, buckets, query, batch_id)
            if changed:
                renewed = rules.upsert_config(
                    configs.read(rules_base, changed), updates, ["timestamp", "sequence_id"]
                )
                configs.write(renewed, rules_base, changed, query, batch_id)

    return start(messages, batch, store.checkpoint("alerts"), trigger)


def _changes_in_batch(telemetry: DataFrame, known: DataFrame, updates: DataFrame) -> DataFrame:
    """Rule changes that readings may meet: the rules known before the batch, then the updates within it.

    Which users the batch has is read from the topics, without looking into the payloads.
    """
    users = telemetry.select(user_id_from_topic(F.col("topic")).alias("user_id")).distinct()
    earlier = known.join(users, "user_id", "left_semi").select(
        "user_id",
        "rules",
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast(SEQUENCE).alias("sequence_id"),
    )
    return earlier.unionByName(updates)


def _arrived(messages: DataFrame, delay: str) -> DataFrame:
    """Topic and arrival time of every enveloped message, with a watermark."""
    decoded = decode_envelope(messages).where(F.col("skip_reason").isNull())
    return decoded.select("topic", F.col("timestamp").alias("ts")).withWatermark("ts", delay)


def start_message_rate(
    messages: DataFrame,
    store: Store,
    length: str = "1 minute",
    delay: str = "10 minutes",
    **trigger,
) -> StreamingQuery:
    """Message rate per window, renewed as messages arrive.

    A window is kept open for ``delay`` after its end; messages later than that are not counted.
    """
    configure(messages.sparkSession)
    rates = metrics.message_rate(_arrived(messages, delay), length=length)

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        append_batch(rows, store.measure("message_rate"), query, batch_id)

    return start(rates, batch, store.checkpoint("message_rate"), trigger, mode="update")


def start_late_messages(
    messages: DataFrame, store: Store, length: str = "1 minute", delay: str = "10 minutes", **trigger
) -> StreamingQuery:
    """Count, per window, the messages that a windowed query with this ``length`` and ``delay`` drops.

    A message is late if its window ended no later than the watermark of its micro-batch: the newest
    arrival of the micro-batches before, less the delay. That newest arrival is written with the counts, so
    a repeated micro-batch finds the one it had, and a new checkpoint starts without a watermark. The
    micro-batches are this query's; one of another query may have cut the stream elsewhere.
    """
    configure(messages.sparkSession)
    log = store.measure("late_messages")

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        decoded = decode_envelope(rows).where(F.col("skip_reason").isNull())
        with _kept(decoded.select(F.col("timestamp").alias("ts"))) as arrived:
            earlier = read_measure(rows.sparkSession, log, LATE).where((F.col("query_id") == query) & (F.col("batch_id") < batch_id))
            newest = earlier.agg(F.max("newest").alias("newest")).first().newest
            watermark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            counted = arrived.groupBy(F.window("ts", length).alias("window")).agg(F.count(F.lit(1)).alias("late"), F.max("ts").alias("newest"))
            late = F.coalesce(F.col("window.end") <= watermark, F.lit(False))
            found = counted.where(late).select(F.col("window.start").alias("window_start"), "late", F.lit(None).cast("timestamp").alias("newest"))
            mark = arrived.agg(F.max("ts").alias("newest")).select(F.lit(None).cast("timestamp").alias("window_start"), F.lit(0).cast("long").alias("late"), "newest")
            append_batch(found.unionByName(mark), log, query, batch_id)

    return start(messages, batch, store.checkpoint("late_messages"), trigger)


LATE = "window_start timestamp, late long, newest timestamp, written_at timestamp, query_id string, batch_id long"


def read_late_messages(spark: SparkSession, store: Store) -> DataFrame:
    """Late messages per window, over all micro-batches."""
    rows = read_measure(spark, store.measure("late_messages"), LATE).where("window_start IS NOT NULL")
    return rows.groupBy("window_start").agg(F.sum("late").alias("late"))


def read_message_rate(spark: SparkSession, store: Store) -> DataFrame:
    """Newest count of every window."""
    rows = spark.read.parquet(store.measure("message_rate"))
    newest = storing.latest_by_key(rows, ["window_start"], ["written_at", "batch_id"])
    return newest.drop(*BATCH_COLUMNS)


def read_write_stats(spark: SparkSession, store: Store) -> DataFrame:
    """Rows offered, written and duplicate per batch of the live writer.

    A batch repeated after it had stored its rows counts them as duplicates.
    """
    rows = spark.read.parquet(store.writes)
    return rows.withColumn("duplicates", F.col("offered") - F.col("written"))


def read_alerts_per_minute(spark: SparkSession, store: Store, length: str = "1 minute") -> DataFrame:
    """Triggered alerts per window of event time, from what the live query has written."""
    return metrics.alerts_per_minute(spark.read.parquet(store.history), length=length)


def read_errors_per_minute(
    spark: SparkSession, store: Store, ts: str = "arrived_at", length: str = "1 minute"
) -> DataFrame:
    """Dead letters per window of arrival and reason, from what the live query has written."""
    letters = spark.read.parquet(store.dead_letters)
    failed = letters.withColumn("error", F.get_json_object("value", "$.error"))
    return metrics.errors_per_minute(failed, ts, length)


# Measures of complete windows. Each is an aggregation of topic counts, which Spark carries on in
# a second aggregation once the watermark has closed a window.
COMPLETE_WINDOWS = {
    "active_topics": metrics.active_topics,
    "avg_topic_rate": metrics.avg_topic_rate,
}


def start_complete_windows(
    messages: DataFrame,
    store: Store,
    measure: str,
    length: str = "1 minute",
    delay: str = "10 minutes",
    **trigger,
) -> StreamingQuery:
    """Write ``active_topics`` or ``avg_topic_rate`` of every window once, when it is complete."""
    configure(messages.sparkSession)
    rows = COMPLETE_WINDOWS[measure](_arrived(messages, delay), length=length)

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        append_batch(rows, store.measure(measure), query, batch_id)

    return start(rows, batch, store.checkpoint(measure), trigger)


def start_top_topics(
    messages: DataFrame,
    store: Store,
    k: int = 5,
    length: str = "1 minute",
    delay: str = "10 minutes",
    **trigger,
) -> StreamingQuery:
    """Write the ``k`` busiest topics of every window once, when it is complete.

    Ranking is no streaming operation, so the counts of complete windows are ranked per batch.
    """
    configure(messages.sparkSession)
    counts = metrics.topic_counts(_arrived(messages, delay), length=length)

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        append_batch(metrics.rank_topics(rows, k), store.measure("top_topics"), query, batch_id)

    return start(counts, batch, store.checkpoint("top_topics"), trigger)


def start_idle_topics(
    messages: DataFrame, store: Store, seconds: int = 60, delay: str = "10 minutes", **trigger
) -> StreamingQuery:
    """Write known, active and idle topics of every window once, when it is complete.

    A registry keeps when each topic was first seen; a micro-batch reads and renews the buckets of its
    topics. Windows become complete in order of time, so the last one written says how many topics were
    known before, and windows without any message between it and the next get rows as well.
    """
    spark = configure(messages.sparkSession)
    counts = metrics.topic_counts(_arrived(messages, delay), length=f"{seconds} seconds")
    registry, log = store.topics(spark), store.measure("idle_topics")

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        seen = rows.select(F.col("window.start").alias("window_start"), "topic")
        with _kept(seen) as seen:
            buckets = registry.touched(seen)
            if not buckets:
                return
            base = registry.before(query, batch_id)
            known = registry.read(base, buckets)
            earlier = read_measure(spark, log, IDLE).where(
                (F.col("query_id") != query) | (F.col("batch_id") < batch_id)
            )
            last = earlier.agg(F.max(F.struct("window_start", "known")).alias("last")).first().last
            firsts = seen.groupBy("topic").agg(F.min("window_start").alias("first_seen"))
            with _kept(firsts.join(known.select("topic"), "topic", "left_anti")) as new:
                idle = metrics.idle_windows(seen, new, seconds, last and last.window_start, last.known if last else 0)
                append_batch(idle, log, query, batch_id)
                registry.write(known.unionByName(new), base, buckets, query, batch_id)

    return start(counts, batch, store.checkpoint("idle_topics"), trigger)


IDLE = "window_start timestamp, known long, active long, idle long, written_at timestamp, query_id string, batch_id long"


def start_offsets(messages: DataFrame, store: Store, **trigger) -> StreamingQuery:
    """Write the last offset read of every source topic and partition, per micro-batch."""

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        read = rows.groupBy("topic", "partition").agg(F.max("offset").alias("committed"))
        append_batch(read, store.measure("offsets"), query, batch_id)

    return start(messages, batch, store.checkpoint("offsets"), trigger)


class OffsetLog(StreamingQueryListener):
    """Writes the offsets of Kafka sources after every trigger of every query of the session.

    To be added with ``spark.streams.addListener``. Kafka offsets name the next message to read, so the
    last one read is one less. Other sources have no such offsets and give no rows.
    """

    def __init__(self, spark: SparkSession, store: Store):
        self._spark, self._path = spark, store.measure("offsets")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        read = [row for source in progress.sources for row in kafka_offsets(source.endOffset)]
        if read:
            rows = self._spark.createDataFrame(read, "topic string, partition int, committed long")
            append_batch(rows, self._path, str(progress.id), progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def kafka_offsets(text: str | None) -> list[tuple[str, int, int]]:
    """(topic, partition, last offset read) of an offset document; nothing if it is of another kind."""
    try:
        topics = json.loads(text or "null")
    except ValueError:
        return []
    if not isinstance(topics, dict) or not all(isinstance(parts, dict) for parts in topics.values()):
        return []
    return [(topic, int(part), int(offset) - 1) for topic, parts in topics.items() for part, offset in parts.items()]


OFFSETS = "topic string, partition int, committed long, written_at timestamp, query_id string, batch_id long"


def replay_dead_letters(
    spark: SparkSession, store: Store, run: str, repair: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, int]:
    """Play dead letters into the stored readings; what went in is kept in a ledger by ``run``.

    A letter that any run has played is left out, so playing twice stores nothing twice. The ledger of a
    run is written before its readings: a run that failed is repeated under its own name, which plays the
    same letters again (storing is first-wins by key). ``repair`` may change ``topic, payload`` first.
    Letters that fail again are counted and stay where they are. Returns how many were played, stored
    and failed.
    """
    configure(spark)
    letters = read_measure(spark, store.dead_letters, LETTERS)
    letters = letters.withColumn("letter", F.sha2(F.concat_ws("\0", "query_id", "batch_id", "key", "value", "arrived_at"), 256))
    others = read_measure(spark, store.ledger, LEDGER).where(F.col("query_id") != run)
    own = read_measure(spark, store.ledger, LEDGER).where(F.col("query_id") == run)
    if own.limit(1).count():
        chosen = letters.join(own.select("letter").distinct(), "letter", "left_semi")
    else:
        chosen = letters.join(others.select("letter"), "letter", "left_anti")
        append_batch(chosen.select("letter", "key").distinct(), store.ledger, run, 0)
        played = read_measure(spark, store.ledger, LEDGER).where(F.col("query_id") == run)
        chosen = letters.join(played.select("letter"), "letter", "left_semi")
    messages = dead_letter.replay_dead_letter(chosen, carry=["arrived_at", "letter"])
    messages = messages if repair is None else repair(messages)
    readings = parse.parse_telemetry(messages).drop("document", "extras")
    with _kept(readings) as readings:
        good, bad = storing.quarantine_split(readings)
        # the first to arrive wins; letters of one moment go by their hash
        place = {"partition": F.lit(0), "offset": F.unix_micros("arrived_at")}
        counts = write_telemetry(good.withColumns(place), store.telemetry)
        return {"played": readings.count(), "stored": counts["written"], "failed": bad.count()}


LETTERS = "key string, value string, arrived_at timestamp, written_at timestamp, query_id string, batch_id long"
LEDGER = "letter string, key string, written_at timestamp, query_id string, batch_id long"


def read_consumer_lag(spark: SparkSession, store: Store, messages: DataFrame) -> DataFrame:
    """Messages not read yet per source topic and partition, by the offsets that live queries wrote.

    ``messages`` are all rows of the source, or one row with the newest offset of each partition.
    """
    read = read_measure(spark, store.measure("offsets"), OFFSETS)
    return metrics.consumer_lag(messages, read.groupBy("topic", "partition").agg(F.max("committed").alias("committed")))
