"""Activity status of a topic.

The status text and the sort bucket treat an unset topic timestamp (0) differently:
the text sees age 0, the bucket sees the age since 1970.  Both are kept on purpose.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog.functions.ages import age_seconds, topic_age_days
from quietlog.schema import SECONDS_PER_DAY


def topic_status(oldest: Column, newest: Column, as_of, stale_days: int, unused_days: int) -> Column:
    """``unused``, ``stale`` or ``active`` from whole days."""
    return (
        F.when(topic_age_days(newest, as_of) >= unused_days, F.lit("unused"))
        .when(topic_age_days(oldest, as_of) >= stale_days, F.lit("stale"))
        .otherwise(F.lit("active"))
    )


def status_bucket(oldest: Column, newest: Column, as_of, stale_days: int, unused_days: int) -> Column:
    """Sort bucket 2 unused, 1 has stale partitions, 0 active."""
    return (
        F.when(age_seconds(newest, as_of) >= unused_days * SECONDS_PER_DAY, F.lit(2))
        .when(age_seconds(oldest, as_of) >= stale_days * SECONDS_PER_DAY, F.lit(1))
        .otherwise(F.lit(0))
    )


def yes_no(flag: Column) -> Column:
    """Text of a boolean."""
    return F.when(flag, F.lit("yes")).otherwise(F.lit("no"))
