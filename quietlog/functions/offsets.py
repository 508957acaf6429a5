"""Message count and emptiness of a partition from its two watermarks."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_count(latest: Column, earliest: Column) -> Column:
    """Retained messages, never negative."""
    return F.greatest(latest - earliest, F.lit(0).cast("bigint"))


def is_empty(latest: Column, earliest: Column) -> Column:
    """Equal watermarks only; an earliest above the latest is not empty."""
    return latest == earliest
