"""Topic listing and watermark scans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.names import is_system_topic


def topic_listing(listing: DataFrame) -> DataFrame:
    """Listed (topic, partition) rows without system topics."""
    return listing.where(~is_system_topic(F.col("topic")))


def listed_partition_counts(listing: DataFrame) -> DataFrame:
    """Topics of a listing with their number of partitions."""
    return topic_listing(listing).groupBy("topic").agg(F.count("partition").cast("int").alias("partition_count"))


def _answers(answers: DataFrame, column: str, strict: bool) -> DataFrame:
    code = F.coalesce(F.col("error_code"), F.lit(0))
    if "broker_error" in answers.columns:
        answers = answers.where(
            F.when(F.col("broker_error").isNull(), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("failed to list offsets: "), F.col("broker_error"))).cast("boolean")))
    if strict:
        answers = answers.where(
            F.when(code == 0, F.lit(True)).otherwise(
                F.raise_error(F.format_string("failed to list offsets of %s partition %d: error code %d",
                                              F.col("topic"), F.col("partition"), code)).cast("boolean")))
    else:
        answers = answers.where(code == 0)
    return answers.select("topic", "partition", F.col("offset").alias(column))


def latest_offsets(answers: DataFrame, strict: bool = False) -> DataFrame:
    """(topic, partition, latest) from offset answers.

    ``answers`` has topic, partition, offset, error_code and, optionally, broker_error.
    A partition error drops the partition, or fails the job when ``strict``; a broker
    error always fails the job.
    """
    return _answers(answers, "latest", strict)


def earliest_offsets(answers: DataFrame, strict: bool = False) -> DataFrame:
    """(topic, partition, earliest) from log-start answers; the same error rules."""
    return _answers(answers, "earliest", strict)


def latest_from_log(records: DataFrame) -> DataFrame:
    """Next offset of each partition of a record log."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("latest"))


def earliest_from_log(records: DataFrame) -> DataFrame:
    """First retained offset of each partition of a record log."""
    return records.groupBy("topic", "partition").agg(F.min("offset").alias("earliest"))


def watermarks_from_log(records: DataFrame, retained) -> DataFrame:
    """Both watermarks in one pass; ``retained`` is the predicate of kept records.

    A partition whose records are all expired has its log start at the next offset.
    """
    return (
        records.groupBy("topic", "partition")
        .agg((F.max("offset") + 1).alias("latest"), F.min(F.when(retained, F.col("offset"))).alias("kept_from"))
        .select("topic", "partition", "latest", F.coalesce("kept_from", "latest").alias("earliest"))
    )
