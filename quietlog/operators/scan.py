"""One scan folded into the previous state."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.offsets import is_empty, message_count
from quietlog.schema import PARTITION_FIELDS, STATE_COLUMNS
from quietlog.sources.tables import materialise

# Partition number of topic markers while they take part in joins.
_MARKER = -1


def join_watermarks(latest: DataFrame, earliest: DataFrame) -> DataFrame:
    """(topic, partition, latest, earliest); a missing earliest offset is 0."""
    return (
        latest.join(earliest, ["topic", "partition"], "left")
        .select("topic", "partition", "latest", F.coalesce("earliest", F.lit(0)).alias("earliest"))
    )


def partition_counts(watermarks: DataFrame) -> DataFrame:
    """Watermarks with message count and emptiness."""
    return watermarks.select(
        "topic", "partition",
        F.col("latest").alias("offset"),
        is_empty(F.col("latest"), F.col("earliest")).alias("is_empty"),
        message_count(F.col("latest"), F.col("earliest")).alias("message_count"),
    )


def deleted_topics(previous: DataFrame, listing: DataFrame) -> DataFrame:
    """Topics of the previous state that are not listed any more."""
    listed = listing.select("topic").distinct()
    return previous.select("topic").distinct().join(listed, "topic", "left_anti")


@dataclass(frozen=True)
class ScanResult:
    """``state`` after the scan, with an ``observed`` flag; ``deleted`` topics."""

    state: DataFrame
    deleted: DataFrame


def fold_scan(previous: DataFrame, listing: DataFrame, observations: DataFrame, scan_time) -> ScanResult:
    """Fold one scan into a state table.

    One full outer join on (topic, partition) covers the comparison with the previous
    row and the carry-over of rows that were not answered.  ``observations`` has a row
    per asked partition; a null latest offset is a partition without an answer.  Rows
    of topics that are listed but not asked stay as they are.
    """
    deleted = materialise(deleted_topics(previous, listing), "deleted-topics")
    now = F.lit(scan_time).cast("bigint")

    answered = (
        observations.where(F.col("latest").isNotNull())
        .select("topic", "partition", "latest", F.coalesce("earliest", F.lit(0)).alias("earliest"))
    )
    processed = observations.select("topic").distinct().select(
        "topic", F.lit(_MARKER).alias("partition"),
        F.lit(None).cast("bigint").alias("latest"), F.lit(None).cast("bigint").alias("earliest"))
    new = answered.unionByName(processed).withColumn("observed", F.lit(True))
    old = previous.select(
        "topic", F.coalesce("partition", F.lit(_MARKER)).alias("partition"),
        *[F.col(name).alias(f"old_{name}") for name in [*PARTITION_FIELDS, "last_update"]])

    latest, earliest = F.col("latest"), F.col("earliest")
    known = F.coalesce(F.col("old_timestamp"), F.lit(0)) != 0
    moved = ~known | (latest > F.col("old_offset"))

    def choose(fresh, name):
        return F.when(latest.isNotNull(), fresh).otherwise(F.col(f"old_{name}")).alias(name)

    observed = F.coalesce(F.col("observed"), F.lit(False))
    state = (
        new.join(old, ["topic", "partition"], "full_outer")
        .select(
            "topic",
            F.nullif(F.col("partition"), F.lit(_MARKER)).alias("partition"),
            choose(latest, "offset"),
            choose(F.when(moved, now).otherwise(F.col("old_timestamp")), "timestamp"),
            choose(is_empty(latest, earliest), "is_empty"),
            choose(now, "scanned_at"),
            choose(message_count(latest, earliest), "message_count"),
            F.when(observed, now).otherwise(F.col("old_last_update")).alias("last_update"),
            observed.alias("observed"),
        )
        .join(deleted, "topic", "left_anti")
    )
    return ScanResult(state.select(*STATE_COLUMNS, "observed"), deleted)


def scan_counters(listing: DataFrame, owned: DataFrame, observations: DataFrame) -> DataFrame:
    """Listed, assigned and processed topics, and processed partitions, of one scan."""
    def mark(frame: DataFrame, **flags) -> DataFrame:
        return frame.select("topic", *[F.lit(flags.get(n, False)).alias(n) for n in ("listed", "assigned", "processed")],
                            flags.get("answers", F.lit(0)).alias("answers"))
    rows = (
        mark(listing, listed=True)
        .unionByName(mark(owned, assigned=True))
        .unionByName(mark(observations, processed=True, answers=F.col("latest").isNotNull().cast("int")))
    )
    by_topic = rows.groupBy("topic").agg(
        F.bool_or("listed").alias("listed"), F.bool_or("assigned").alias("assigned"),
        F.bool_or("processed").alias("processed"), F.sum("answers").alias("answers"))
    return by_topic.agg(
        F.count_if("listed").alias("listed_topics"),
        F.count_if("assigned").alias("assigned_topics"),
        F.count_if("processed").alias("processed_topics"),
        F.coalesce(F.sum("answers"), F.lit(0)).alias("processed_partitions"),
    )
