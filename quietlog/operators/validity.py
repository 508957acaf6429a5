"""State as of any scan from validity intervals.

Each answer of a partition is valid from its scan until the next answer, or until the
topic was deleted.  Intervals are stored by periods: an interval has a row in each period that it
touches, so the state at any instant is read from the files of one period, however long the
history is, by a filter alone.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietlog.operators.history import last_change_history, returns_of, topic_epochs
from quietlog.schema import PARTITION_FIELDS
from quietlog.sources.tables import materialise

#: The end of intervals that are still valid.
OPEN = 2**62


def validity_intervals(observations: DataFrame, listing: DataFrame) -> DataFrame:
    """(topic, partition, valid_from, valid_to, fields): the answers of every partition, ends excluded."""
    epochs = materialise(topic_epochs(listing), "topic-epochs")
    scans = epochs.select("scan_time").distinct().withColumn("next_scan", F.lead("scan_time").over(Window.orderBy("scan_time")))  # one row per scan
    ends = epochs.groupBy("topic", "epoch").agg(F.max("scan_time").alias("scan_time")).join(scans, "scan_time").select(
        "topic", "epoch", F.col("next_scan").alias("ended"))
    answered = last_change_history(observations, returns_of(epochs)).where(F.col("offset").isNotNull())
    by_scan = Window.partitionBy("topic", "partition", "epoch").orderBy("scan_time")
    return (
        answered.withColumn("next_answer", F.lead("scan_time").over(by_scan))
        .join(ends, ["topic", "epoch"])
        .select("topic", "partition", F.col("scan_time").alias("valid_from"),
                F.coalesce("next_answer", "ended", F.lit(OPEN)).alias("valid_to"),
                "offset", "timestamp", "is_empty", F.col("scan_time").alias("scanned_at"), "message_count")
    )


def write_intervals(intervals: DataFrame, path: str, period: int, until: int) -> None:
    """Store intervals by periods of ``period`` seconds up to the one of ``until``."""
    def number(time):
        return F.floor(time / F.lit(period)).cast("long")
    last = F.least(number(F.col("valid_to") - 1), number(F.lit(until)))
    spread = intervals.withColumn("period", F.explode(F.sequence(number(F.col("valid_from")), F.greatest(last, number(F.col("valid_from"))))))
    # A period is written by as many tasks as its rows need.
    spread.repartition("period", F.pmod(F.xxhash64("topic", "partition"), F.lit(8))).write.partitionBy("period").parquet(path)


def read_as_of(spark: SparkSession, path: str, time: int, period: int) -> DataFrame:
    """(topic, partition, fields) valid at ``time``; only the files of its period are read."""
    rows = spark.read.parquet(path).where(F.col("period") == F.lit(time // period))
    return rows.where((F.col("valid_from") <= time) & (F.col("valid_to") > time)).select("topic", "partition", *PARTITION_FIELDS)
