"""Ages of timestamps at a given instant."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog.schema import SECONDS_PER_DAY


def _seconds(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("bigint")


def _div(value: Column, divisor: int) -> Column:
    # Integral division, truncating toward zero.
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def age_seconds(since: Column, as_of) -> Column:
    return _seconds(as_of) - since


def age_days(since: Column, as_of) -> Column:
    """Whole days of age as INT."""
    return _div(age_seconds(since, as_of), SECONDS_PER_DAY).cast("int")


def topic_age_days(timestamp: Column, as_of) -> Column:
    """Age in days of a rolled-up topic timestamp, where 0 means unset and has age 0."""
    return F.when(timestamp > 0, age_days(timestamp, as_of)).otherwise(F.lit(0))


def age_parts(elapsed: Column) -> Column:
    """STRUCT<days, hours, minutes, seconds> of a number of seconds (F1)."""
    return F.struct(
        _div(elapsed, 86400).cast("int").alias("days"),
        (_div(elapsed, 3600) % 24).cast("int").alias("hours"),
        (_div(elapsed, 60) % 60).cast("int").alias("minutes"),
        (elapsed % 60).cast("int").alias("seconds"),
    )


def age_text(elapsed: Column) -> Column:
    """The first two non-zero units, such as ``1 day 5 seconds`` (F2)."""
    parts = age_parts(elapsed)
    units = []
    for field, name in [("days", "day"), ("hours", "hour"), ("minutes", "minute"), ("seconds", "second")]:
        count = parts[field]
        units.append(
            F.when(count == 1, F.lit(f"1 {name}"))
            .when(count > 1, F.concat(count.cast("string"), F.lit(f" {name}s")))
        )
    two_units = F.slice(F.array_compact(F.array(*units)), 1, 2)
    return F.when(F.size(two_units) == 0, F.lit("0 seconds")).otherwise(F.array_join(two_units, " "))


def topic_age_text(timestamp: Column, as_of) -> Column:
    elapsed = F.when(timestamp > 0, age_seconds(timestamp, as_of)).otherwise(F.lit(0).cast("bigint"))
    return age_text(elapsed)


def is_stale(partition_timestamp: Column, as_of, stale_days: int) -> Column:
    """A partition's own age is counted even from timestamp 0."""
    return age_days(partition_timestamp, as_of) >= F.lit(stale_days)


def utc_text(seconds: Column) -> Column:
    """RFC 3339 text in UTC, whatever the session time zone is."""
    shifted = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp read as UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))
