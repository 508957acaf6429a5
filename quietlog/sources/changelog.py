"""Readers and writers of the keyed changelog (S1, S2, K-sinks, R5).

Every reader returns the columns of ``schema.CHANGELOG``; a null value is a
tombstone, an empty value is a malformed record, and the two stay distinct.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.operators.codec import topic_of
from quietlog.schema import CHANGELOG

# Offsets with a special meaning for the Kafka source.
LATEST = -1


def normalise(records: DataFrame) -> DataFrame:
    """Kafka-source frames (binary key and value) and tables become one layout."""
    return records.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
    )


def from_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All records of a table-backed changelog."""
    return normalise(spark.read.schema(CHANGELOG).format(fmt).load(path))


def from_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """All records from the start to the high watermark taken when the job is planned."""
    reader = (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
    )
    return normalise(reader.options(**options).load())


def stream_table(spark: SparkSession, path: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a table-backed changelog as a stream."""
    reader = spark.readStream.schema(CHANGELOG).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalise(reader.load(path))


def stream_kafka(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "latest",
                 **options: str) -> DataFrame:
    """The tail of the log from ``starting_offsets`` (see ``starting_offsets_json``)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    return normalise(reader.options(**options).load())


def starting_offsets_json(topic: str, resume: DataFrame, partition_count: int) -> str:
    """``startingOffsets`` for a tail that begins where a batch replay ended.

    ``resume`` is (partition, next_offset), one row per changelog partition, so the
    driver sees only as many rows as the log has partitions.  Partitions that the
    replay did not know start at the latest offset.
    """
    known = {row["partition"]: row["next_offset"] for row in resume.select("partition", "next_offset").collect()}
    return json.dumps({topic: {str(p): known.get(p, LATEST) for p in range(partition_count)}})


def append_to_table(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append encoded records to a table-backed changelog."""
    records.write.mode("append").format(fmt).save(path)


def append_to_kafka(records: DataFrame, servers: str, topic: str, partition_count: int | None = None,
                    **options: str) -> None:
    """Produce encoded records; the producer picks the partition from the key.

    With ``partition_count`` the partition follows from the topic's name, so that all
    slices of a wide topic lie in one and their offsets compare.
    """
    columns = ["key", "value"]
    if partition_count:
        records = records.withColumn("partition", F.pmod(F.xxhash64(topic_of(F.col("key"))), F.lit(partition_count)).cast("int"))
        columns.append("partition")
    (records.select(*columns).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic)
     .options(**options).save())
