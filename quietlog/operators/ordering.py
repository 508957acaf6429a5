"""Topic orders and pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions.status import status_bucket
from quietlog.arguments import Page, Thresholds, sort_arguments


def topic_order(as_of, thresholds: Thresholds, sort_by: str | None = None,
                sort_dir: str | None = None) -> list[Column]:
    """Sort columns of the topic reports.

    Ties go by lower-case name ascending, also in a descending order; the plain name
    comes last so that the order is total.
    """
    key, descending = sort_arguments(sort_by, sort_dir)
    by_name = F.lower("name")
    column = {
        "name": by_name,
        "partitions": F.col("partition_count"),
        "age": F.col("oldest_timestamp"),
        "status": status_bucket(F.col("oldest_timestamp"), F.col("newest_timestamp"), as_of,
                                thresholds.stale_days, thresholds.unused_days),
        "empty": F.col("is_empty"),
        "messages": F.col("total_message_count"),
    }[key]
    first = column.desc() if descending else column.asc()
    return [first, F.col("name")] if key == "name" else [first, by_name, F.col("name")]


def page_of(rows: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """The rows of one page with their 1-based ``position`` in the whole order (T4).

    Planned lazily as a top-k per task at any depth.  The position is counted over the
    page only, which has at most ``MAX_PAGE_SIZE`` rows.
    """
    top = rows.orderBy(*order).offset(page.offset).limit(page.limit)
    position = F.row_number().over(Window.orderBy(*order)) + F.lit(page.offset)
    return top.withColumn("position", position.cast("int"))


def page_meta(rows: DataFrame, page: Page) -> DataFrame:
    """Count of the page, total, page, limit and has_more, from one count."""
    total = F.col("total")
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        F.least(F.greatest(total - F.lit(page.offset), F.lit(0).cast("bigint")), F.lit(page.limit).cast("bigint"))
        .alias("count"),
        "total",
        F.lit(page.number).alias("page"),
        F.lit(page.limit).alias("limit"),
        (total > F.lit(page.offset + page.limit)).alias("has_more"),
    )
