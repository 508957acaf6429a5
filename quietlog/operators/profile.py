"""Quality figures of a changelog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.operators.codec import decode, slice_of, topic_of
from quietlog.operators.replay import arrival


def changelog_profile(changelog: DataFrame, moved_keys: bool = False) -> DataFrame:
    """One row of counters (A4, A5).

    Further slices of wide topics are keys, but not topics.  A single shuffle by key: each key brings its counts and the kind of its last valid
    record, from which the surviving topics and instances follow.
    """
    last_valid = F.max_by("is_tombstone", F.when(F.col("is_valid"), arrival(moved_keys)))
    by_key = (
        decode(changelog)
        .groupBy("key", F.col("instance_id").isNotNull().alias("is_heartbeat"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if("is_tombstone").alias("tombstones"),
            F.count_if(~F.col("is_valid")).alias("malformed"),
            # Null when the key has no valid record at all.
            last_valid.alias("deleted"),
        )
    )
    survives = F.coalesce(~F.col("deleted"), F.lit(False))
    def total(column) -> F.Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    counted = by_key.agg(
        total("records").alias("total_records"),
        total("tombstones").alias("tombstone_records"),
        total(F.when(F.col("is_heartbeat"), F.col("records"))).alias("heartbeat_records"),
        total(F.when(~F.col("is_heartbeat"), F.col("records"))).alias("topic_state_records"),
        total("malformed").alias("malformed_records"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.count_if(survives & ~F.col("is_heartbeat") & slice_of(F.col("key")).isNull()).alias("final_topics"),
        F.count_if(survives & F.col("is_heartbeat")).alias("final_instances"),
    )
    kept = F.col("final_topics") + F.col("final_instances")
    return counted.select(
        "*",
        (F.col("total_records") - F.col("unique_keys")).alias("duplicate_key_records"),
        F.greatest(F.col("total_records") - kept, F.lit(0).cast("bigint")).alias("discarded_records"),
    )


def approximate_unique_keys(changelog: DataFrame, relative_error: float = 0.01) -> DataFrame:
    """Sketch-based number of keys for a quick look at a huge log (A5)."""
    return changelog.agg(F.approx_count_distinct("key", relative_error).alias("unique_keys"))


SKETCH_SIZE = 14  # logarithm of the registers: a relative error of about 0.8 %


def batch_profile(changelog: DataFrame) -> DataFrame:
    """One row of what can be added up over batches of a growing log: counters, and a sketch of the keys (A4, A5).

    Keep one such row per batch; ``merged_profile`` of all rows then never reads the log again.
    """
    flags = decode(changelog)
    is_heartbeat = F.col("instance_id").isNotNull()
    return flags.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_tombstone").alias("tombstone_records"),
        F.count_if(is_heartbeat).alias("heartbeat_records"),
        F.count_if(~is_heartbeat).alias("topic_state_records"),
        F.count_if(~F.col("is_valid")).alias("malformed_records"),
        F.hll_sketch_agg("key", SKETCH_SIZE).alias("keys"),
    )


def merged_profile(batches: DataFrame) -> DataFrame:
    """One row for all ``batch_profile`` rows; ``unique_keys`` is the estimate of the united sketches."""
    counters = ["total_records", "tombstone_records", "heartbeat_records", "topic_state_records", "malformed_records"]
    return batches.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counters],
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("keys")), F.lit(0)).alias("unique_keys"))


def key_mismatches(changelog: DataFrame) -> DataFrame:
    """Number of topic records whose ``topic`` field differs from their key."""
    return decode(changelog).agg(
        F.count_if(F.col("is_valid") & (F.col("topic_record.topic") != topic_of(F.col("key")))).alias("key_mismatches"))


def resume_offsets(changelog: DataFrame, partition_count: int | None = None) -> DataFrame:
    """(partition, next_offset) of every changelog partition, 0 for empty ones."""
    ends = changelog.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))
    if partition_count is None:
        return ends
    all_partitions = changelog.sparkSession.range(partition_count, numPartitions=1).select(
        F.col("id").cast("int").alias("partition"), F.lit(0).cast("bigint").alias("next_offset"))
    return ends.unionByName(all_partitions).groupBy("partition").agg(F.max("next_offset").alias("next_offset"))


def partitions_with_data(changelog: DataFrame) -> DataFrame:
    """Number of changelog partitions that hold a record (A4)."""
    return changelog.agg(F.count_distinct("partition").alias("partitions_with_data"))
