"""Reading of comma-separated configuration lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_compact(value: Column) -> Column:
    """Whether a clean-up policy list names ``compact``."""
    return F.exists(F.split(value, ","), lambda item: F.lower(F.btrim(item, F.lit(" \t\r\n"))) == "compact")
