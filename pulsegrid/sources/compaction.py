"""Compaction of stored readings: many small files of a day become few, ordered by key.

The files of a day are written anew, sorted by device and time, with bloom filters on the device. A commit
record names the new folder and the files it stands for; it appears whole or not at all. From then on
``read_telemetry`` reads the new folder and leaves those files out, whether ``clean`` has deleted them yet or
not. Files that ingest adds meanwhile are in no record and stay. A compaction that dies before its record
leaves a folder that nobody reads. One compaction of a table runs at a time; ingest needs no pause.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.files import Files

#: Rows of a compacted file, about.
FILE_ROWS = 5_000_000
KEY_RANGE = ["device_id", "time"]


def _home(path: str) -> str:
    return f"{path.rstrip('/')}_compacted"


def records(spark: SparkSession, path: str) -> list[dict]:
    """Committed compactions, oldest first: ``folder``, ``day`` and the names of the files ``replaced``."""
    folder = f"{_home(path)}/commits"
    files = Files(spark, folder)
    return [json.loads(files.read(f"{folder}/{n}")) for n in files.names(folder) if not n.startswith(".")]


def compact_day(spark: SparkSession, path: str, day: str, file_rows: int = FILE_ROWS) -> dict[str, int]:
    """Compact the files of one day (``2024-01-31``); returns how many ``files`` were read and rows ``written``.

    A day of fewer than two files is left alone. ``clean`` deletes what was replaced.
    """
    folder = f"{path}/dt={day}"
    files = Files(spark, folder)
    gone = {n for r in records(spark, path) if r["day"] == day for n in r["replaced"]}
    names = [n for n in files.names(folder) if not n.startswith(("_", ".")) and n not in gone]
    if len(names) < 2:
        return {"files": 0, "written": 0}
    rows = spark.read.parquet(*[f"{folder}/{n}" for n in names])
    total = rows.count()
    name = f"{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(-(-total // file_rows), *KEY_RANGE).sortWithinPartitions(*KEY_RANGE)
    writer = ordered.write.option("parquet.bloom.filter.enabled#device_id", "true")
    writer.parquet(f"{_home(path)}/rows/folder={name}/dt={day}")
    commits = f"{_home(path)}/commits"
    number = 1 + max((int(n.split("-")[0]) for n in files.names(commits) if not n.startswith(".")), default=-1)
    record = {"folder": name, "day": day, "replaced": names}
    files.write(f"{commits}/{number:012d}-{name}", json.dumps(record))
    return {"files": len(names), "written": total}


def clean(spark: SparkSession, path: str) -> int:
    """Delete files that committed compactions replaced; queries that still read them would fail.

    Records keep the names: a file once replaced is never read again. Returns how many were deleted.
    """
    deleted = 0
    for record in records(spark, path):
        folder = f"{path}/dt={record['day']}"
        files = Files(spark, folder)
        for name in sorted(set(files.names(folder)) & set(record["replaced"])):
            files.delete(f"{folder}/{name}")
            deleted += 1
    return deleted


def with_compacted(spark: SparkSession, path: str, stored: DataFrame, schema: T.StructType) -> DataFrame:
    """``stored`` (all files below ``path``) without replaced files, and the rows that stand for them."""
    known = records(spark, path)
    if not known:
        return stored
    leftover = []
    for record in known:
        folder = f"{path}/dt={record['day']}"
        leftover += sorted(set(Files(spark, folder).names(folder)) & set(record["replaced"]))
    columns = [f.name for f in schema]
    if leftover:
        stored = stored.where(~F.col("_metadata.file_name").isin(leftover))
    named = T.StructType([*schema.fields, T.StructField("folder", T.StringType())])
    compacted = spark.read.schema(named).parquet(f"{_home(path)}/rows")
    compacted = compacted.where(F.col("folder").isin([r["folder"] for r in known]))
    return stored.select(*columns).unionByName(compacted.select(*columns))
