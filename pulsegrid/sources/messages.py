"""Message streams: Kafka where its connector is installed, parquet files of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.schemas import MESSAGE_ROW


def kafka_source(
    spark: SparkSession,
    brokers: str,
    topic: str,
    starting: str = "latest",
    max_offsets: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of message rows from a Kafka topic, with headers.

    ``starting`` counts only for a new checkpoint; afterwards its offsets do. ``max_offsets``
    bounds a micro-batch and so takes the place of back-pressure.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("includeHeaders", "true")
        .options(**options)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets))
    return reader.load().select(*MESSAGE_ROW.names)


def file_source(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Stream of message rows from parquet files with the columns of a Kafka source."""
    reader = spark.readStream.schema(MESSAGE_ROW)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a source with fewer files than the cluster has cores, spread over the cores.

    Parsing text is bound by the processor, and one file is often one task. A source of many
    files is returned as it is: there a shuffle of raw rows would only cost.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(cores, key)


def write_kafka(messages: DataFrame, brokers: str, topic: str | None = None, **options) -> None:
    """Send ``key, value`` rows to Kafka; without ``topic``, each row names its own."""
    writer = messages.write.format("kafka").option("kafka.bootstrap.servers", brokers)
    if topic is not None:
        writer = writer.option("topic", topic)
    writer.options(**options).save()
