"""Liveness of an emitter from its last heartbeat."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog.schema import DEFAULT_HEARTBEAT_INTERVAL_SEC


def is_active(last_heartbeat_at: Column, interval_sec: Column, as_of) -> Column:
    """Alive up to and including three intervals after the last heartbeat."""
    interval = F.when(interval_sec > 0, interval_sec.cast("bigint")).otherwise(
        F.lit(DEFAULT_HEARTBEAT_INTERVAL_SEC).cast("bigint"))
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("bigint")
    return (last_heartbeat_at > 0) & (now <= last_heartbeat_at + interval * 3)
