"""Pages from a rank index equal slices of the sorted rows."""

import pytest
from pyspark.sql import functions as F

from quietlog.arguments import Page
from quietlog.operators import ranking


@pytest.mark.parametrize("count,per_range", [(0, 10), (7, 10), (500, 30), (500, 1000)])
def test_pages_at_any_depth(spark, tmp_path, count, per_range):
    path = str(tmp_path / "index")
    rows = [(f"n{i:04d}", i * 7919 % 13) for i in range(count)]
    order = [F.col("value").desc(), F.col("name")]
    ranking.build_rank_index(spark.createDataFrame(rows, "name string, value int"), order, path, per_range)
    assert ranking.index_total(spark, path) == count
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    for number in (1, 2, 3, 9, 50):
        page = Page.of(number, 20)
        found = [(r.name, r.value) for r in ranking.indexed_page(spark, path, order, page).orderBy("position").collect()]
        assert found == expected[page.offset:page.offset + 20]


def test_a_page_reads_its_ranges_only(spark, tmp_path):
    path = str(tmp_path / "index")
    order = [F.col("id")]
    ranking.build_rank_index(spark.range(10_000), order, path, 500)
    page = ranking.indexed_page(spark, path, order, Page.of(300, 30))
    assert page.agg(F.min("id"), F.max("id"), F.max("position")).first()[:] == (8970, 8999, 9000)
    sizes = {r["range"]: r["rows"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert len(sizes) > 10
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range" in plan
