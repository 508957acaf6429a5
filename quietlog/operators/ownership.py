"""Shards of the work and their owners."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.sharding import shard
from quietlog.schema import DEFAULT_SHARDS


def with_shard(rows: DataFrame, shard_count: int = DEFAULT_SHARDS) -> DataFrame:
    return rows.withColumn("shard", shard(F.col("topic"), F.col("partition"), shard_count))


def owned_partitions(rows: DataFrame, assigned: DataFrame | Iterable[int],
                     shard_count: int = DEFAULT_SHARDS) -> DataFrame:
    """Rows whose shard is assigned, given as numbers or as a ``shard`` column.

    Numbers become a literal predicate, as there are never more of them than shards.
    """
    sharded = with_shard(rows, shard_count)
    if isinstance(assigned, DataFrame):
        return sharded.join(assigned.select("shard").distinct(), "shard", "left_semi").select(*rows.columns, "shard")
    return sharded.where(F.col("shard").isin(sorted(set(assigned))))


def shard_balance(rows: DataFrame, shard_count: int = DEFAULT_SHARDS) -> DataFrame:
    """Partitions per shard."""
    return with_shard(rows, shard_count).groupBy("shard").agg(F.count(F.lit(1)).alias("partitions"))


def shard_skew(rows: DataFrame, shard_count: int = DEFAULT_SHARDS) -> DataFrame:
    """Smallest and largest shard and their spread."""
    return shard_balance(rows, shard_count).agg(
        F.count(F.lit(1)).alias("shards"),
        F.min("partitions").alias("min_partitions"),
        F.max("partitions").alias("max_partitions"),
        F.round(F.stddev_pop("partitions"), 6).alias("stddev_partitions"),
    )
