"""Emitter instances."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.liveness import is_active


def with_liveness(heartbeats: DataFrame, as_of) -> DataFrame:
    """Heartbeats with ``is_active`` as seen at ``as_of``."""
    return heartbeats.withColumn(
        "is_active", is_active(F.col("last_heartbeat_at"), F.col("heartbeat_interval_sec"), as_of))


def live_instances(heartbeats: DataFrame, as_of) -> DataFrame:
    """Instances that a replay keeps."""
    return with_liveness(heartbeats, as_of).where("is_active")


def expired_instances(heartbeats: DataFrame, as_of) -> DataFrame:
    """Instances that a replay drops and marks as deleted in the log."""
    return with_liveness(heartbeats, as_of).where(~F.col("is_active"))
