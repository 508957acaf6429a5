"""Partition rows to topic rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.ages import is_stale


def partitions_of(state: DataFrame) -> DataFrame:
    """The partition rows of a state table, without topic markers."""
    return state.where(F.col("partition").isNotNull())


def topic_rollup(state: DataFrame, as_of=None, stale_days: int | None = None) -> DataFrame:
    """One row per topic.

    Every aggregate merges partial results, so a topic with any number of partitions
    costs one row per task in the shuffle.  Timestamps of 0 are unset: the oldest and
    newest are taken over the others and are 0 if there are none.  A topic without
    partitions is not empty.  With ``stale_days`` the number of stale partitions is
    counted in the same pass.
    """
    has_partition = F.col("partition").isNotNull()
    stamp = F.when(has_partition, F.nullif(F.col("timestamp"), F.lit(0)))
    aggregates = [
        F.count("partition").cast("int").alias("partition_count"),
        F.coalesce(F.min(stamp), F.lit(0)).alias("oldest_timestamp"),
        F.coalesce(F.max(stamp), F.lit(0)).alias("newest_timestamp"),
        # Null without any partition row, which reads as not empty.
        F.coalesce(F.bool_and(F.when(has_partition, F.col("is_empty"))), F.lit(False)).alias("is_empty"),
        F.coalesce(F.sum(F.when(has_partition, F.col("message_count"))), F.lit(0)).alias("total_message_count"),
        F.max("last_update").alias("last_update"),
    ]
    if stale_days is not None:
        aggregates.append(
            F.count_if(has_partition & is_stale(F.col("timestamp"), as_of, stale_days)).alias("stale_partitions"))
    return state.groupBy(F.col("topic").alias("name")).agg(*aggregates)
