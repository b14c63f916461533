"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Without these settings results differ.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Of two equal keys in one JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; safe to repeat."""
    for name, value in REQUIRED_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is taken, but only on a local master: on a
    cluster a machine-local folder would lose data with the machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="pulsegrid-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir() or folder
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """New path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder made by ``fresh_folder`` once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
