"""Shape of the physical plans: what must hold at any size of the data."""

import io
from contextlib import redirect_stdout

import pytest

from quietlog.workload.registry import queries

SF = "/root/testdata/sf0.001"
ALL = queries()
STREAMS = [name for name in ALL if name.startswith("stream_")]


def plan(frame, mode="simple"):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", [name for name in ALL if name not in STREAMS])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(ALL[name](spark, SF))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "InPandas"):
        assert forbidden not in text, text


@pytest.mark.parametrize("name", ["list_topics_by_name", "list_topics_by_status", "unused_topics", "empty_topics"])
def test_pages_are_top_k(spark, name):
    text = plan(ALL[name](spark, SF))
    assert "TakeOrderedAndProject" in text


def test_columns_are_pruned(spark):
    text = plan(ALL["scan_latest_offsets"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    for name in ("scan_watermarks", "topic_listing", "unused_topics_from_log"):
        text = plan(ALL[name](spark, SF))
        assert "ReadSchema" in text and "props" not in text and "value:double" not in text


def test_last_change_reuses_one_shuffle(spark):
    """Over the observation table, both windows run on the only shuffle there is."""
    text = plan(ALL["last_change_backfill"](spark, SF))
    assert text.count("Exchange hashpartitioning(") == 1 and text.count("Window [") == 2, text
    # The aggregation to a state needs none in addition; the other one is for the live topics.
    text = plan(ALL["state_as_of_scan"](spark, SF))
    assert text.count("Exchange hashpartitioning(") == 2 and text.count("Window [") == 2, text


def test_filters_reach_the_scan(spark, tmp_path):
    from quietlog.plans import reports
    from quietlog.schema import STATE
    path = str(tmp_path / "state")
    spark.createDataFrame([("a", 0, 1, 1, False, 1, 1, 1)], STATE).write.parquet(path)
    state = spark.read.schema(STATE).parquet(path)
    assert "EqualTo(topic,a)" in plan(reports.topic_detail(state, "a"))
    assert "StringStartsWith(topic,ord)" in plan(reports.list_report(state, 1, prefix="ord"))
    from quietlog.sources.watermarks import topic_listing
    assert "Not(StringStartsWith(topic,_))" in plan(topic_listing(state))
    from quietlog.sources.configs import topic_configs
    from quietlog.schema import TOPIC_CONFIG
    configs = str(tmp_path / "configs")
    spark.createDataFrame([("a", "x", "1")], TOPIC_CONFIG).write.parquet(configs)
    assert "IsNotNull(value)" in plan(topic_configs(spark.read.schema(TOPIC_CONFIG).parquet(configs), ["x"]))


def test_rollup_merges_partial_results(spark):
    text = plan(ALL["stale_by_topic"](spark, SF))
    assert "partial_count" in text and "SortAggregate" not in text
