"""Topic configuration scan."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_configs(configs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(topic, name, value) without null values, optionally only the given names."""
    configs = configs.where(F.col("value").isNotNull())
    if names:
        configs = configs.where(F.col("name").isin(list(names)))
    return configs.select("topic", "name", "value")
