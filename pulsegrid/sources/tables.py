"""File tables that repeated batches leave right: dated readings, batch logs, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.parse import find_message
from pulsegrid.operators.storing import anti_join_existing, dedupe_first_wins, touched, with_date
from pulsegrid.schemas import TELEMETRY, DomainSpec
from pulsegrid.sources.compaction import with_compacted
from pulsegrid.sources.files import Files

# Dates listed one by one in the partition filter; more are found by a join.
LISTED_DATES = 1000

def read_readings(spark: SparkSession, path: str, spec: DomainSpec) -> DataFrame:
    """Stored readings of a domain, compacted or not; an absent table is empty."""
    return with_compacted(spark, path, _read(spark, path, spec.table), spec.table)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Stored telemetry."""
    return read_readings(spark, path, TELEMETRY)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def find_stored(
    spark: SparkSession, path: str, device_id: str, sequence_id: int, first_day: str, last_day: str
) -> DataFrame:
    """Stored rows of one device and sequence number between two dates, both included.

    Only the folders of these dates are read, and in them the row groups that may hold the device.
    """
    days = F.col("dt").between(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))
    return find_message(read_telemetry(spark, path).where(days), device_id, sequence_id)


def write_telemetry(rows: DataFrame, path: str) -> dict[str, int]:
    """Store telemetry once; see ``write_readings``."""
    return write_readings(rows, path, TELEMETRY)


def write_readings(rows: DataFrame, path: str, spec: DomainSpec) -> dict[str, int]:
    """Store readings once: the first row of a key wins, in the batch and against the table.

    The time of ``spec`` is part of its key. Needs the arrival columns ``partition, offset``. Only the dates of the batch are compared,
    and running the same batch again stores nothing new, so a repeated micro-batch is harmless.
    Large dates are written by several tasks, small ones share a task. Returns how many rows were
    ``offered`` and ``written``.
    """
    spark, key, time = rows.sparkSession, list(spec.key), spec.time
    if time not in key:
        raise ValueError(f"{time} must be part of the key")
    span = [F.min(time).alias("low"), F.max(time).alias("high"), F.count(F.lit(1)).alias("n")]
    dated = with_date(rows, time).groupBy("dt").agg(*span)
    found = dated.limit(LISTED_DATES + 1).collect()
    if not found:
        return {"offered": 0, "written": 0}
    dates = [r.dt for r in found]
    listed = len(dates) <= LISTED_DATES
    whole = None if listed else dated.agg(F.min("low"), F.max("high"), F.sum("n")).first()
    low, high, offered = whole or (min(r.low for r in found), max(r.high for r in found), sum(r.n for r in found))
    firsts = with_date(dedupe_first_wins(rows.select(*spec.stored, "partition", "offset"), key), time)
    # time is part of the key, so only the batch's span of it can hold copies
    stored = read_readings(spark, path, spec).where(F.col(time).between(F.lit(low), F.lit(high)))
    same_dates = touched(stored, firsts, dates if listed else None)
    new = anti_join_existing(firsts, same_dates, key).select(*spec.stored, "dt")
    new = new.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        written = new.count()
        if written:
            laid_out = new.hint("rebalance", "dt").sortWithinPartitions("dt", time)
            laid_out.write.mode("append").partitionBy("dt").parquet(path)
    finally:
        new.unpersist()
    return {"offered": offered, "written": written}


def append_batch(rows: DataFrame, path: str, query_id: str, batch_id: int) -> None:
    """Append the rows of one batch; repeating the batch replaces its own rows only.

    A query with another checkpoint has another id, so it never touches what is there already.
    """
    stamped = rows.withColumn("written_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(f"{path}/query_id={query_id}/batch_id={batch_id}")


BATCH_COLUMNS = ["query_id", "batch_id", "written_at"]


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches, without the columns that say which batch wrote them."""
    return spark.read.parquet(path).drop(*BATCH_COLUMNS)


def read_measure(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of all batches with the columns that say which wrote them; an absent table is empty."""
    return _read(spark, path, T.StructType.fromDDL(columns))


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the streaming query that owns a checkpoint folder."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint}/metadata"))["id"]


class Snapshots:
    """A keyed table kept as versions that share what they do not change.

    Rows lie in buckets by a hash of their key. A version names, for each bucket, the folder that
    holds it; it writes only buckets that changed. The list is written last, so a version without
    one does not exist yet. Versions are numbered in the order they were committed, whichever query
    wrote them, and carry their query and batch: a repeated batch goes on from the version before
    its own. Folders that no kept version names any more are removed here, and nothing else is.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._files = Files(spark, path)

    def bucket(self) -> Column:
        """Bucket of a row by its key columns."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of rows that have the key columns; at most ``buckets`` numbers."""
        found = rows.select(self.bucket().alias("_bucket")).distinct().collect()
        return sorted(r._bucket for r in found)

    def _versions(self) -> list[dict]:
        names = [n for n in self._files.names(f"{self.path}/versions") if not n.startswith(".")]
        return [json.loads(self._files.read(f"{self.path}/versions/{n}")) for n in names[-2 * self.KEPT :]]

    def before(self, query: str, batch: int) -> dict | None:
        """Newest version that is not of this batch of this query, or a later one of it."""
        older = [v for v in self._versions() if v["query"] != query or v["batch"] < batch]
        return older[-1] if older else None

    def read(self, version: dict | None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, of all buckets or of some; no version has no rows."""
        parts = {} if version is None else version["parts"]
        folders = [f for b, f in sorted(parts.items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def latest(self) -> DataFrame:
        known = self._versions()
        return self.read(known[-1] if known else None)

    def write(
        self, rows: DataFrame, base: dict | None, buckets: list[int], query: str, batch: int
    ) -> None:
        """Commit a version: ``rows`` are all rows of ``buckets``, the others stay as in ``base``."""
        known = self._versions()
        number = known[-1]["number"] + 1 if known else 0
        folder = f"rows/{number:012d}-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema]
        rows.select(*columns, self.bucket().alias("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        parts = {} if base is None else {b: f for b, f in base["parts"].items() if int(b) not in buckets}
        for name in self._files.names(f"{self.path}/{folder}"):
            if name.startswith("bucket="):
                parts[name.removeprefix("bucket=")] = f"{folder}/{name}"
        version = {"number": number, "query": query, "batch": batch, "parts": parts}
        self._files.write(f"{self.path}/versions/{number:012d}", json.dumps(version))
        self._remove_superseded([*known, version])

    def seed(self, rows: DataFrame) -> None:
        """Commit the rows of an existing table as the first version; a table in use is left alone."""
        if self._versions():
            raise ValueError(f"{self.path} has versions already")
        self.write(rows, None, list(range(self.buckets)), "seed", 0)

    def _remove_superseded(self, known: list[dict]) -> None:
        kept = known[-self.KEPT :]
        used = {f.split("/")[1] for v in kept for f in v["parts"].values()}
        newest = kept[-1]["number"]
        for name in self._files.names(f"{self.path}/rows"):
            if name not in used and int(name.split("-")[0]) <= newest:
                self._files.delete(f"{self.path}/rows/{name}")
        for version in known[: -self.KEPT]:
            self._files.delete(f"{self.path}/versions/{version['number']:012d}")
