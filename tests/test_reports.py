"""Roll-up, orders, pages and reports on literal states."""

import json

import pytest
from pyspark.sql import functions as F

from quietlog.arguments import Page, Thresholds
from quietlog.operators.ordering import page_of, topic_order
from quietlog.operators.rollup import topic_rollup
from quietlog.plans import reports
from quietlog.schema import STATE
from quietlog.sources.watermarks import listed_partition_counts

DAY = 86400
NOW = 1_700_000_000


def state(spark, rows):
    """Rows are (topic, partition, age in days or None for timestamp 0, is_empty, count)."""
    return spark.createDataFrame([
        (t, p, None if p is None else 10, None if p is None else (0 if age is None else NOW - age * DAY),
         None if p is None else empty, None if p is None else NOW, None if p is None else count, NOW)
        for t, p, age, empty, count in rows], STATE)


def test_rollup(spark):
    rows = {r.name: r for r in topic_rollup(state(spark, [
        ("a", 0, 3, True, 0), ("a", 1, 9, False, 4), ("zero", 0, None, True, 0), ("mixed", 0, None, True, 0),
        ("mixed", 1, 5, True, 0), ("bare", None, None, None, None), ("a", None, None, None, None)]), NOW, 7).collect()}
    assert tuple(rows["a"])[1:] == (2, NOW - 9 * DAY, NOW - 3 * DAY, False, 4, NOW, 1)
    assert tuple(rows["zero"])[1:6] == (1, 0, 0, True, 0) and rows["zero"].stale_partitions == 1
    assert tuple(rows["mixed"])[1:5] == (2, NOW - 5 * DAY, NOW - 5 * DAY, True)
    assert tuple(rows["bare"])[1:] == (0, 0, 0, False, 0, NOW, 0)


def names(report):
    return [r.name for r in report.rows.orderBy("position").collect()]


def test_orders(spark):
    frame = state(spark, [("beta", 0, 10, False, 5), ("alpha", 0, 10, True, 5), ("Gamma", 0, 2, False, 9), ("Gamma", 1, 2, False, 0)])
    def order(by, direction=None):
        return names(reports.list_topics(frame, NOW, sort_by=by, sort_dir=direction))
    assert order("age", "desc") == ["Gamma", "alpha", "beta"]
    assert order("age") == ["alpha", "beta", "Gamma"]
    assert order("name") == ["alpha", "beta", "Gamma"]
    assert order("name", "desc") == ["Gamma", "beta", "alpha"]
    assert order("partitions", "desc") == ["Gamma", "alpha", "beta"]
    assert order("messages", "desc") == ["Gamma", "alpha", "beta"]
    assert order("empty", "desc") == ["alpha", "beta", "Gamma"]
    assert order("empty") == ["beta", "Gamma", "alpha"]
    assert order("status", "desc") == ["alpha", "beta", "Gamma"]
    assert order("unknown", "up") == ["alpha", "beta", "Gamma"]


def test_pages(spark):
    frame = state(spark, [(t, 0, 1, False, 1) for t in "abcd"])
    report = reports.list_topics(frame, NOW, page=2, limit=2)
    assert names(report) == ["c", "d"]
    assert tuple(report.meta.first()) == (2, 4, 2, 2, False)
    assert [r.position for r in report.rows.orderBy("position").collect()] == [3, 4]
    past = reports.list_topics(frame, NOW, page=5, limit=2)
    assert names(past) == [] and tuple(past.meta.first()) == (0, 4, 5, 2, False)
    first = reports.list_topics(frame, NOW, page=1, limit=3, search="[A-C]")
    assert names(first) == ["a", "b", "c"] and tuple(first.meta.first()) == (3, 3, 1, 3, False)
    assert reports.list_topics(frame, NOW, limit=3).meta.first().has_more is True


@pytest.mark.parametrize("sort_by", ["name", "age"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_follow_one_another(spark, sort_by, direction):
    frame = state(spark, [(f"t{i % 40:02d}", 0, i % 7, False, 1) for i in range(40)])
    topics = topic_rollup(frame)
    order = topic_order(NOW, Thresholds.of(), sort_by, direction)
    whole = [(r.name, i) for i, r in enumerate(topics.orderBy(*order).collect(), 1)]
    for number in range(1, 8):
        page = page_of(topics, order, Page.of(number, 7)).orderBy("position")
        assert [(r.name, r.position) for r in page.collect()] == whole[7 * number - 7:7 * number]


def test_bad_arguments_raise_before_any_job(spark):
    frame = state(spark, [("a", 0, 1, False, 1)])
    for options in ({"page": 0}, {"limit": "x"}, {"stale_days": 9, "unused_days": 3}, {"search": "("}):
        with pytest.raises(ValueError):
            reports.list_topics(frame, NOW, **options)


def test_unused_and_empty(spark):
    frame = state(spark, [("old", 0, 30, False, 1), ("young", 0, 29, True, 0), ("unset", 0, None, True, 0),
                          ("bare", None, None, None, None)])
    assert names(reports.unused_topics(frame, NOW)) == ["old"]
    assert names(reports.empty_topics(frame, NOW)) == ["unset", "young"]
    assert names(reports.unused_topics(frame, NOW, stale_days=1, unused_days=29)) == ["old", "young"]


def test_topic_detail(spark):
    frame = state(spark, [("a", 1, 3, False, 4), ("a", 0, 9, True, 0), ("b", 0, 1, False, 1)])
    assert [r.partition for r in reports.topic_detail(frame, "a").collect()] == [0, 1]
    head = reports.topic_header(frame, "a").first()
    assert tuple(head) == ("a", 2, NOW - 9 * DAY, NOW - 3 * DAY, NOW, False)
    assert reports.topic_detail(frame, "A").count() == 0 and reports.topic_header(frame, "x").count() == 0


def test_cluster_stats(spark):
    frame = state(spark, [("old", 0, 30, False, 1), ("old", 1, 40, False, 1), ("mid", 0, 8, False, 1), ("new", 0, 1, False, 1)])
    alive = spark.createDataFrame([("i", True), ("j", False)], "instance_id string, is_active boolean")
    row = reports.cluster_stats(frame, NOW, alive, last_scan=5, local_instance_id="me").first()
    assert tuple(row) == (3, 4, 1, 3, 7, 30, 1, 5, True, "me")
    assert reports.cluster_stats(state(spark, []), NOW).first().total_topics == 0


def test_list_report(spark):
    frame = state(spark, [("b", 0, 31, False, 2), ("a", 0, 31, False, 1), ("c", 0, 40, True, 0), ("c", 3, 50, True, 0),
                          ("young", 0, 1, True, 0)])
    rows = reports.list_report(frame, NOW).collect()
    assert [r.name for r in rows] == ["c", "a", "b"]
    assert (rows[0].status, rows[0].empty, rows[0].stale_partitions, rows[0].oldest_partition_age) == ("unused", "yes", 2, "50 days")
    assert [r.name for r in reports.list_report(frame, NOW, empty_only=True).collect()] == ["c", "young"]
    assert [r.name for r in reports.list_report(frame, NOW, prefix="c", search="C").collect()] == ["c"]
    report = reports.list_report(frame, NOW)
    assert {(r.topic, r.partition) for r in reports.list_sub_rows(report, frame, NOW).collect()} == {("a", 0), ("b", 0), ("c", 0), ("c", 3)}
    assert tuple(reports.list_header(report, 0).first()) == ("1970-01-01T00:00:00Z", 3)


def test_list_documents(spark, tmp_path):
    frame = state(spark, [("c", p, 40, False, 1) for p in range(5)])
    report = reports.list_report(frame, NOW)
    plain = json.loads(reports.list_documents(report).first().document)
    assert plain["stale_partitions"] == 5 and "stale_partition_details" not in plain
    whole = json.loads(reports.list_documents(report, frame, NOW).first().document)
    assert [d["partition"] for d in whole["stale_partition_details"]] == [0, 1, 2, 3, 4]
    assert whole["stale_partition_details"][0] == {"partition": 0, "offset": 10, "age": "40 days", "message_count": 1}
    sliced = reports.list_documents(report, frame, NOW, slice_width=2)
    reports.write_documents(sliced, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((line["slice"], len(line["stale_partition_details"])) for line in lines) == [(0, 2), (1, 2), (2, 1)]
    assert {line["slices"] for line in lines} == {3} and (plain["slice"], plain["slices"]) == (0, 1)


def test_scan_summary_and_documents(spark):
    frame = state(spark, [("old", 0, 30, False, 1), ("older", 0, 60, False, 1), ("new", 0, 1, False, 1)])
    assert tuple(reports.scan_summary(frame, NOW, prefix="old").first()) == (3, 2, 2)
    assert tuple(reports.scan_summary(frame, NOW).first()) == (3, 3, 2)
    body = json.loads(reports.topic_documents(frame, NOW, search="OLDER").first().document)
    assert body["partitions"]["0"]["age"] == {"days": 60, "hours": 0, "minutes": 0, "seconds": 0}
    assert body["newest_partition_age"]["days"] == 60


def test_stale_partitions(spark):
    frame = state(spark, [("a", 0, 6, False, 1), ("a", 1, 7, False, 1), ("z", 0, None, True, 0), ("m", None, None, None, None)])
    assert {(r.topic, r.partition) for r in reports.stale_partitions(frame, NOW).collect()} == {("a", 1), ("z", 0)}
    assert {(r.topic, r.partition) for r in reports.stale_partitions(frame, NOW, 5).collect()} == {("a", 0), ("a", 1), ("z", 0)}


def test_as_of_may_be_a_subquery(spark):
    frame = state(spark, [("a", 0, 40, False, 1), ("b", 0, 0, False, 1)])
    now = frame.agg(F.max("timestamp")).scalar()
    assert [r.name for r in reports.list_report(frame, now).collect()] == ["a"]


def test_listed_partition_counts(spark):
    rows = spark.createDataFrame([("_s", 0), ("a", 0), ("a", 1)], "topic string, partition int")
    assert [tuple(r) for r in listed_partition_counts(rows).collect()] == [("a", 2)]
