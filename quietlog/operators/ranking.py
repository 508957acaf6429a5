"""Pages of any depth from a rank index.

The rows are stored by ranges of their order, with the number of rows before each range.  A page then
reads the ranges that it lies in and nothing else, so no task ever holds more than a range and
a page, at the first page as at the last.  The index serves every page of one order.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietlog.arguments import Page

ROWS_PER_RANGE = 100_000


def build_rank_index(rows: DataFrame, order: list[Column], path: str, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Store ``rows`` under ``path`` in the given total order, in ranges of about ``rows_per_range`` rows."""
    ranges = 1 + rows.count() // rows_per_range
    placed = rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    placed.write.partitionBy("range").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/columns")  # the columns, should there be no row
    stored = _rows(rows.sparkSession, path)
    counts = stored.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range.
    counts.withColumn("first", F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).write.parquet(f"{path}/ranks")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("range", "integer")).parquet(f"{path}/rows")


def indexed_page(spark: SparkSession, path: str, order: list[Column], page: Page) -> DataFrame:
    """The rows of one page with their 1-based ``position``; ``order`` is the one of the index."""
    ranks = spark.read.parquet(f"{path}/ranks").where(
        (F.col("first") < page.offset + page.limit) & (F.col("first") + F.col("rows") > page.offset))
    found = ranks.agg(F.collect_list("range").alias("ranges"), F.min("first").alias("first")).first()
    before = found["first"] or 0
    rows = _rows(spark, path).where(F.col("range").isin(found["ranges"])).drop("range")
    top = rows.orderBy(*order).offset(max(page.offset - before, 0)).limit(page.limit)
    position = F.row_number().over(Window.orderBy(*order)) + F.lit(page.offset)
    return top.withColumn("position", position.cast("int"))


def index_total(spark: SparkSession, path: str) -> int:
    """Number of rows in the index, from its ranks."""
    return spark.read.parquet(f"{path}/ranks").agg(F.sum("rows")).first()[0] or 0
