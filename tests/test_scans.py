"""Scan folds: literal cases, and all forms against a literal fold on random data."""

import random

import pytest
from pyspark.sql import functions as F

from quietlog.operators import history, scan
from quietlog.operators.ownership import owned_partitions, shard_skew
from quietlog.operators.replay import replay_topics
from quietlog.plans.scan_cycle import run_scan, scan_once, scan_state
from quietlog.schema import CHANGELOG, LISTING, OBSERVATION, STATE
from quietlog.sources import changelog as log_source
from quietlog.sources import watermarks
from quietlog.sources.tables import join_side, materialise
from tests.folds import fold_scans, of_state

HOUR = 3600
NOW = 1774699200


def state(spark, rows):
    return spark.createDataFrame(rows, STATE)


def listing(spark, scans):
    rows = [(t, p, time) for time, listed, _ in scans for t, ps in listed.items() for p in (ps or [None])]
    return spark.createDataFrame(rows, LISTING)


def observations(spark, scans):
    rows = [(t, p, time, *answer) for time, _, answers in scans for t, ps in answers.items() for p, answer in ps.items()]
    return spark.createDataFrame(rows, OBSERVATION)


@pytest.mark.parametrize("previous,current,expected", [
    (None, 100, NOW), ((100, NOW - 6 * HOUR), 100, NOW - 6 * HOUR), ((100, NOW - 48 * HOUR), 101, NOW),
    ((100, NOW - 72 * HOUR), 95, NOW - 72 * HOUR), ((100, 0), 100, NOW)])
def test_last_change(spark, previous, current, expected):
    rows = [] if previous is None else [("t", 0, previous[0], previous[1], False, 1, 1, 1)]
    scans = [(NOW, {"t": [0]}, {"t": {0: (current, 0)}})]
    folded = scan.fold_scan(state(spark, rows), listing(spark, scans), observations(spark, scans), NOW).state
    row = of_state(folded)["t"][0]
    assert (row[0], row[1]) == (current, expected)
    resumed = history.resume_scans(state(spark, rows), listing(spark, scans), observations(spark, scans), NOW, NOW).state
    assert of_state(resumed)["t"][0] == row


def test_backward_then_forward(spark):
    scans = [(i, {"t": [0]}, {"t": {0: (v, None)}}) for i, v in [(10, 100), (20, 95), (30, 96)]]
    result = of_state(history.state_as_of(observations(spark, scans), listing(spark, scans), 30))
    assert result["t"][0] == (96, 30, False, 30, 96)


@pytest.mark.parametrize("latest,earliest,empty,count", [
    (42, 42, True, 0), (42, 0, False, 42), (5, 9, False, 0), (7, None, False, 7), (0, None, True, 0)])
def test_partition_state(spark, latest, earliest, empty, count):
    scans = [(5, {"t": [0]}, {"t": {0: (latest, earliest)}})]
    row = of_state(history.state_as_of(observations(spark, scans), listing(spark, scans), 5))["t"][0]
    assert (row[2], row[4]) == (empty, count)


def random_scans(seed, count=12):
    rng = random.Random(seed)
    topics = {f"topic-{i}": rng.randint(1, 5) for i in range(14)}
    offsets = {}
    scans = []
    for n in range(1, count + 1):
        listed, answers = {}, {}
        for topic, width in topics.items():
            if rng.random() < 0.15:
                continue
            listed[topic] = list(range(width)) if rng.random() < 0.95 else []
            if not listed[topic] or rng.random() < 0.1:
                continue
            answer = {}
            for partition in listed[topic]:
                draw = rng.random()
                if draw < 0.1:
                    continue
                if draw < 0.2:
                    answer[partition] = (None, None)
                    continue
                offset = max(offsets.get((topic, partition), 0) + rng.choice([-3, 0, 0, 0, 1, 5]), 0)
                offsets[topic, partition] = offset
                answer[partition] = (offset, rng.choice([None, 0, offset, max(offset - 2, 0)]))
            if answer:
                answers[topic] = answer
        scans.append((1000 + 10 * n, listed, answers))
    return scans


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_as_of_equals_literal_fold(spark, seed):
    scans = random_scans(seed)
    seen, asked = listing(spark, scans), observations(spark, scans)
    for n in (4, 9, len(scans)):
        expected = fold_scans(scans[:n])
        assert of_state(history.state_as_of(asked, seen, scans[n - 1][0]), with_update=True) == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_scan_by_scan_equals_literal_fold(spark, seed):
    scans = random_scans(seed, 6)
    current = state(spark, [])
    for n, one in enumerate(scans, start=1):
        result = scan.fold_scan(current, listing(spark, [one]), observations(spark, [one]), one[0])
        rows = result.state.drop("observed").collect()
        before = fold_scans(scans[:n - 1])
        assert {r.topic for r in result.deleted.collect()} == set(before) - set(one[1])
        current = state(spark, rows)
        assert of_state(current, with_update=True) == fold_scans(scans[:n])


@pytest.mark.parametrize("seed,cuts", [(6, [5]), (7, [1, 2, 9]), (8, [])])
def test_resumed_passes_equal_literal_fold(spark, seed, cuts):
    scans = random_scans(seed)
    current, done = state(spark, []), 0
    for cut in [*cuts, len(scans)]:
        part = scans[done:cut]
        result = history.resume_scans(current, listing(spark, part), observations(spark, part), part[0][0], part[-1][0])
        before = set(fold_scans(scans[:done]))
        missing = {t for t in before if any(t not in listed for _, listed, _ in part)}
        assert {r.topic for r in result.deleted.collect()} == missing
        current = state(spark, result.state.drop("observed").collect())
        done = cut
        assert of_state(current, with_update=True) == fold_scans(scans[:done])


def test_scan_cycle_through_the_log(spark, tmp_path):
    """Every scan replays the log, folds and appends; the last replay is the literal fold."""
    scans = random_scans(9, 5)
    path = str(tmp_path / "log")
    spark.createDataFrame([], CHANGELOG).write.parquet(path)
    for n, one in enumerate(scans):
        def append(records, n=n):
            placed = records.select("key", "value", F.lit(0).alias("partition"), F.lit(n).cast("bigint").alias("offset"),
                                    F.timestamp_seconds(F.lit(one[0])).alias("timestamp"))
            log_source.append_to_table(placed, path)
        assert run_scan(log_source.from_table(spark, path), listing(spark, [one]), observations(spark, [one]), one[0], append)
    expected = {topic: partitions for topic, (_, partitions) in fold_scans(scans).items()}
    assert of_state(replay_topics(log_source.from_table(spark, path), 1)) == expected


def test_scan_without_owned_partitions_writes_nothing(spark):
    scans = [(10, {"t": [0], "empty": []}, {"t": {0: (1, 0)}})]
    previous = state(spark, [("old", 0, 1, 1, False, 1, 1, 1)])
    assert scan_state(previous, listing(spark, scans), observations(spark, scans), 10, assigned=[]) is None
    log = spark.createDataFrame([], CHANGELOG)
    assert scan_once(log, listing(spark, [(10, {"t": []}, {})]), observations(spark, []), 10) is None


def test_only_owned_partitions_are_scanned_but_deletion_sees_all(spark):
    scans = [(10, {"t": list(range(12))}, {"t": {p: (p + 1, 0) for p in range(12)}})]
    previous = state(spark, [("gone", 0, 1, 1, False, 1, 1, 1), ("t", 3, 1, 1, False, 1, 1, 1)])
    outcome = scan_state(previous, listing(spark, scans), observations(spark, scans), 10, assigned=[2])
    owned = {r.partition for r in owned_partitions(listing(spark, scans), [2]).collect()}
    assert set(of_state(outcome.state)["t"]) == owned | {3}
    assert [r.key for r in outcome.records.where("value is null").collect()] == ["gone"]
    by_frame = owned_partitions(listing(spark, scans), spark.createDataFrame([(2,)], "shard int"))
    assert {r.partition for r in by_frame.collect()} == owned
    assert 0 < len(owned) < 12
    skew = shard_skew(listing(spark, scans)).first()
    assert skew.shards <= 6 and skew.min_partitions <= skew.max_partitions


def test_system_topics_and_zero_partition_topics(spark):
    scans = [(10, {"_sys": [0], "t": [0], "bare": []}, {"_sys": {0: (5, 0)}, "t": {0: (1, 0)}})]
    previous = state(spark, [("bare", 0, 4, 4, False, 4, 4, 4)])
    outcome = scan_state(previous, listing(spark, scans), observations(spark, scans), 10)
    assert set(of_state(outcome.state)) == {"t", "bare"}
    assert {r.key for r in outcome.records.collect()} == {"t"}


def test_answers(spark):
    answers = spark.createDataFrame([("t", 0, 5, 0), ("t", 1, 7, 3), ("u", 0, 1, 0)], "topic string, partition int, offset long, error_code int")
    assert {(r.topic, r.partition, r.latest) for r in watermarks.latest_offsets(answers).collect()} == {("t", 0, 5), ("u", 0, 1)}
    assert {r.earliest for r in watermarks.earliest_offsets(answers).collect()} == {5, 1}
    with pytest.raises(Exception, match="error code 3"):
        watermarks.latest_offsets(answers, strict=True).collect()
    broken = answers.withColumn("broker_error", F.when(F.col("topic") == "u", F.lit("unreachable")))
    with pytest.raises(Exception, match="unreachable"):
        watermarks.latest_offsets(broken).collect()


def test_scan_counters(spark):
    scans = [(10, {"a": [0, 1], "b": [0], "c": [0]}, {"a": {0: (1, 0), 1: (None, None)}, "b": {0: (2, 0)}})]
    seen = listing(spark, scans)
    row = scan.scan_counters(seen, seen.where("topic <> 'c'"), observations(spark, scans)).first()
    assert tuple(row) == (3, 2, 2, 2)


def test_retained_watermarks(spark):
    log = spark.createDataFrame([("t", 0, 0, 1), ("t", 0, 1, 5), ("t", 1, 0, 1)], "topic string, partition int, offset long, ts long")
    rows = {(r.partition, r.latest, r.earliest) for r in watermarks.watermarks_from_log(log, F.col("ts") > 3).collect()}
    assert rows == {(0, 2, 1), (1, 1, 1)}


@pytest.mark.parametrize("seed,cuts", [(42, [3, 4, 3]), (43, [1, 8, 1])])
def test_several_scans_in_one_pass(spark, seed, cuts):
    series, held, state, records = random_scans(seed, 10), [], spark.createDataFrame([], STATE), []
    for n in cuts:
        part = series[len(held):len(held) + n]
        times = [time for time, _, _ in part]
        fold = history.fold_scans(state, listing(spark, part), observations(spark, part), times)
        for time, *_ in part:
            expected = fold_scans(held := [*held, series[len(held)]])
            rows = fold.versions.where(F.col("scan_time") == time)
            found = of_state(rows.drop("scan_time", "observed"))
            assert found == {t: p for t, (update, p) in expected.items() if update == time}
            gone = {r.topic for r in fold.ended.where(F.col("scan_time") == time).collect()}
            assert gone == set(fold_scans(held[:-1])) - set(held[-1][1])
        changed = fold.changed.collect()
        keys = {(r.topic, r.partition) for r in changed}
        assert len(keys) == len(changed)
        kept = [r for r in state.collect() if (r.topic, r.partition) not in keys]
        state = spark.createDataFrame([tuple(r) for r in kept] + [tuple(r)[:-1] for r in changed if not r.deleted], STATE)
        assert of_state(state, with_update=True) == fold_scans(held)


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def threshold(spark):
    """Sets what may be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def test_topics_times_scans_are_not_broadcast(spark, threshold):
    """20,000 rows, whose files are below the threshold and whose memory is above it."""
    rows = spark.range(20_000).select(
        F.concat(F.lit("topic-"), F.col("id") % 1000).alias("topic"), F.lit(0).alias("partition"),
        F.floor(F.col("id") / 1000).alias("scan_time"), F.col("id").alias("latest"), F.lit(0).cast("bigint").alias("earliest"))
    rows, plans = materialise(rows, "scans"), {}

    def table(frame, purpose):
        plans[purpose] = physical(frame)
        return materialise(frame, purpose)
    threshold("300k")
    fold = history.fold_scans(spark.createDataFrame([], STATE), rows, rows, range(20), table)
    assert "SortMergeJoin" in plans["processed-topics"] and "BroadcastHashJoin" not in plans["processed-topics"]
    assert "SortMergeJoin" in physical(fold.versions) and "BroadcastHashJoin" not in physical(fold.versions)
    now = fold.changed.where("partition is not null")
    assert now.count() == 1000 and now.where("offset = 19000 + substr(topic, 7) and timestamp = 19").count() == 1000
    assert fold.versions.count() == 2 * 20_000


def test_a_side_of_a_join_goes_by_its_rows(spark, threshold):
    left, right = (materialise(spark.range(1000), "side") for _ in range(2))  # a row counts 16 bytes
    broadcast, merge = "BroadcastHashJoin", "SortMergeJoin"
    for size, rows, kind in (("16000b", 1000, broadcast), ("15999b", 1000, merge), ("15999b", 999, broadcast), ("-1", 1000, merge)):
        threshold(size)
        assert kind in physical(left.join(join_side(right, rows), "id"))
