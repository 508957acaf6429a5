"""Codec, replay, merge and profile of the changelog."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quietlog.functions.ages import utc_text
from quietlog.operators import audit, codec, instances, profile, replay
from quietlog.schema import CHANGELOG, HEARTBEAT, STATE
from quietlog.sources import changelog as log_source
from quietlog.sources.configs import topic_configs
from tests import folds

NOW = 1774864800
BROKEN = "{not-json"


def record(topic, partitions, timestamp=0, **extra):
    """``partitions`` is {id: (offset, timestamp, is_empty, scanned_at, message_count)}."""
    names = ("offset", "timestamp", "is_empty", "scanned_at", "message_count")
    body = {str(p): {"partition": p, **dict(zip(names, fields))} for p, fields in partitions.items()}
    return json.dumps({"version": 1, "topic": topic, "timestamp": timestamp, "partitions": body, **extra})


def offset_only(offset, scanned_at=0):
    return (offset, NOW, False, scanned_at, 0)


def beat(instance, last=NOW, interval=30, shards=0, group=""):
    return (f"tracker-instance:{instance}", json.dumps({
        "version": 1, "instance_id": instance, "last_heartbeat_at": last, "heartbeat_interval_sec": interval,
        "assigned_shards": shards, "group_id": group}))


def log(spark, records):
    rows = [(key, value, 0, i, None) for i, (key, value) in enumerate(records)]
    return spark.createDataFrame(rows, CHANGELOG)


def test_classification(spark):
    keys = ["tracker-instance:a", "tracker-instance:", "tracker-instance:  ", "tracker", "", "xtracker-instance:a"]
    rows = codec.decode(log(spark, [(k, None) for k in keys])).collect()
    assert [r.instance_id for r in rows] == ["a", None, None, None, None, None]


@pytest.mark.parametrize("value,valid", [
    (record("t", {0: offset_only(1)}), True), ("{}", True), ('{"partitions":null}', True), ('{"partitions":{"0":null}}', True),
    ('{"unknown":1}', True), ("{} \n", True), (None, True),
    ("", False), (BROKEN, False), ("[]", False), ("null", False), ('{"partitions":{"a":{}}}', False),
    ('{"partitions":{" 1":{}}}', False), ('{"partitions":{"99999999999":{}}}', False), ('{"timestamp":"5"}', False),
    ('{"timestamp":1.5}', False), ("{} x", False), ('{"partitions":[]}', False), ('{"version":3000000000}', False)])
def test_validity(spark, value, valid):
    assert codec.decode(log(spark, [("t", value)])).first()["is_valid"] is valid


def test_absent_fields_are_zero(spark):
    rows = folds.of_state(replay.replay_topics(log(spark, [("t", '{"partitions":{"3":{"partition":9},"4":null}}')]), 1))
    assert rows == {"t": {3: (0, 0, False, 0, 0), 4: (0, 0, False, 0, 0)}}


def test_repeated_partition_numbers(spark):
    value = '{"partitions":{"0":{"offset":1},"1":{"offset":2},"00":{"offset":3},"+1":{"offset":4},"0":{"offset":5}}}'
    frame = log(spark, [("t", value)])
    for rows in (folds.of_state(replay.replay_topics(frame, 1)), folds.of_state(replay.merge_topics(frame))):
        assert {p: f[0] for p, f in rows["t"].items()} == {0: 5, 1: 4}


@pytest.mark.parametrize("fold", [replay.replay_topics, None])
def test_live_records(spark, fold):
    def topics(records):
        frame = log(spark, records)
        return folds.of_state(fold(frame, 1) if fold else replay.merge_topics(frame))
    assert topics([("events", record("events", {0: offset_only(42)}))])["events"][0][0] == 42
    assert topics([("orders", record("orders", {0: offset_only(10)})), ("orders", None)]) == {}
    assert topics([beat("inst-2")]) == {}
    one, two = record("events", {0: offset_only(10), 1: offset_only(20)}), record("events", {2: offset_only(30), 3: offset_only(40)})
    assert set(topics([("events", one), ("events", two)])["events"]) == ({2, 3} if fold else {0, 1, 2, 3})
    newer = [("orders", record("orders", {0: offset_only(50, NOW)})), ("orders", record("orders", {0: offset_only(100, NOW + 60)}))]
    assert topics(newer)["orders"][0][0] == 100
    assert topics([("t", record("t", {0: offset_only(1)})), ("t", BROKEN)])["t"][0][0] == 1
    assert topics([("t", "{}")]) == {"t": {}}


def random_records(seed, count=400):
    rng = random.Random(seed)
    records = []
    for i in range(count):
        topic = f"t{rng.randint(0, 9)}"
        draw = rng.random()
        if draw < 0.07:
            records.append((topic, None))
        elif draw < 0.14:
            records.append((topic, rng.choice([BROKEN, "", "[1]"])))
        else:
            partitions = {p: (rng.randint(0, 99), rng.randint(0, 99), rng.random() < 0.5, rng.randint(0, 6), rng.randint(0, 9))
                          for p in rng.sample(range(6), rng.randint(0, 5))}
            records.append((topic, record(topic, partitions, timestamp=i)))
    return records


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_equal_literal_folds(spark, seed):
    records = random_records(seed)
    frame = log(spark, records)
    assert folds.of_state(replay.replay_topics(frame, 5)) == folds.replay(records)
    merged = folds.of_state(replay.merge_topics(frame), with_update=True)
    assert merged == folds.merge(records)


def test_moved_keys_are_ordered_by_time(spark):
    rows = spark.createDataFrame([
        ("t", record("t", {0: offset_only(1)}), 0, 900, 10), ("t", record("t", {0: offset_only(2)}), 1, 3, 20)],
        "key string, value string, partition int, offset long, at int").withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    assert folds.of_state(replay.replay_topics(rows, 1, moved_keys=True))["t"][0][0] == 2
    assert folds.of_state(replay.merge_topics(rows, moved_keys=True))["t"][0][0] == 2
    assert profile.changelog_profile(rows, moved_keys=True).first()["final_topics"] == 1


def state(spark, topics):
    rows = [(t, p, *fields, None) for t, ps in topics.items() for p, fields in ps.items()]
    rows += [(t, None, None, None, None, None, None, 9) for t in topics]
    return spark.createDataFrame(rows, STATE)


def test_encoding(spark):
    topics = {"a": {0: (5, 7, False, 9, 3), 10: (1, 2, True, 0, 0), 2: (0, 0, False, 0, 0)}, "none": {}}
    rows = {r.key: r.value for r in codec.encode_topics(state(spark, topics), 77).collect()}
    assert rows["a"] == (
        '{"version":1,"topic":"a","timestamp":77,"partitions":{'
        '"0":{"partition":0,"offset":5,"timestamp":7,"is_empty":false,"scanned_at":9,"message_count":3},'
        '"10":{"partition":10,"offset":1,"timestamp":2,"is_empty":true},'
        '"2":{"partition":2,"offset":0,"timestamp":0,"is_empty":false}}}')
    assert rows["none"] == '{"version":1,"topic":"none","timestamp":77,"partitions":{}}'
    assert [r.key for r in codec.encode_topic(state(spark, topics), "a", 1).collect()] == ["a"]
    assert codec.encode_topics(state(spark, {}), 1).count() == 0


WIDE = {"wide": {p: (p, p, False, 1, 1) for p in range(25)}, "slim": {0: (1, 1, False, 1, 1)}}


def replayed(spark, records):
    return folds.of_state(replay.replay_topics(log(spark, records), 1))


def compacted(records):
    """What a compacted log keeps: the last record of every key."""
    return list(dict(records).items())


def test_wide_topics_survive_compaction(spark):
    """Every slice has a key of its own; a later slice replaces only its range."""
    rows = codec.encode_topics(state(spark, WIDE), 1, slice_width=10).orderBy("key", "slice").collect()
    assert [(r.key, r.slice) for r in rows] == [("slim", 0), ("wide", 0), ("wide#1", 1), ("wide#2", 2)]
    assert '"slices":3,"slice_width":10,"ranges":[1,2]' in rows[1].value and '"slice":2,"slice_width":10' in rows[3].value
    assert "slice" not in rows[0].value
    records = [(r.key, r.value) for r in rows]
    assert replayed(spark, compacted(records * 2)) == WIDE
    assert folds.of_state(replay.merge_topics(log(spark, records))) == WIDE
    changed = record("wide", {24: offset_only(99)}, slice=2, slice_width=10)
    later = replayed(spark, compacted([*records, ("wide#2", changed)]))["wide"]
    assert set(later) == {*range(20), 24} and later[24][0] == 99
    figures = profile.changelog_profile(log(spark, records)).first()
    assert (figures["final_topics"], figures["unique_keys"]) == (2, 4)
    assert profile.key_mismatches(log(spark, records)).first()["key_mismatches"] == 0


def test_whole_records_replace_all_slices(spark):
    records = [(r.key, r.value) for r in codec.encode_topics(state(spark, WIDE), 1, slice_width=10).collect()]
    whole = ("wide", record("wide", {p: offset_only(7) for p in (0, 12, 24)}))
    assert set(replayed(spark, compacted([*records, whole]))["wide"]) == {0, 12, 24}
    # a later writer with another width replaces every range of the earlier one
    other = [(r.key, r.value) for r in codec.encode_topics(state(spark, WIDE), 2, slice_width=9).collect()]
    assert replayed(spark, [*records, *other]) == replayed(spark, compacted([*records, *other])) == WIDE
    # wide once more after the whole record
    assert replayed(spark, compacted([*records, whole, *records])) == WIDE


def test_a_topic_that_grows_again_brings_no_old_range_back(spark):
    records = [(r.key, r.value) for r in codec.encode_topics(state(spark, WIDE), 1, slice_width=10).collect()]
    whole = ("wide", record("wide", {p: offset_only(7) for p in range(3)}))
    regrown = {"wide": {**{p: (p, 1, False, 1, 1) for p in range(3)}, **{p: (p, 1, False, 1, 1) for p in range(20, 25)}}}
    again = [(r.key, r.value) for r in codec.encode_topics(state(spark, regrown), 1, slice_width=10).collect()]
    assert {key for key, _ in again} == {"wide", "wide#2"}
    for between in ([whole], [("wide", None)], [("wide", None), whole], [("wide", BROKEN), whole]):
        for read in (list, compacted):
            assert replayed(spark, read([*records, *between, *again]))["wide"] == regrown["wide"]


def test_tombstones_of_wide_topics(spark):
    frame = state(spark, WIDE)
    records = [(r.key, r.value) for r in codec.encode_topics(frame, 1, slice_width=10).collect()]
    gone = codec.topic_tombstones(spark.createDataFrame([("wide",)], "topic string"), frame, slice_width=10)
    deleted = [(r.key, r.value) for r in gone.collect()]
    assert sorted(deleted) == [("wide", None), ("wide#1", None), ("wide#2", None)]
    assert set(replayed(spark, [*records, *deleted])) == {"slim"}
    assert set(folds.of_state(replay.merge_topics(log(spark, [*records, *deleted])))) == {"slim"}
    assert set(replayed(spark, [*records, ("wide", None)])) == {"slim"}  # no head, no topic
    again = ("wide", record("wide", {0: offset_only(3)}))
    assert set(replayed(spark, compacted([*records, *deleted, again]))["wide"]) == {0}


def test_the_head_is_written_with_any_slice(spark):
    flagged = state(spark, WIDE).withColumn("observed", F.coalesce(F.col("partition") == 24, F.lit(False)))
    keys = [r.key for r in codec.encode_topics(flagged, 1, observed_only=True, slice_width=10).collect()]
    assert sorted(keys) == ["wide", "wide#2"]


def test_unobserved_topics_are_not_written(spark):
    flagged = state(spark, {"a": {0: (1, 1, False, 1, 1), 1: (2, 2, False, 1, 1)}, "b": {0: (1, 1, False, 1, 1)}}).withColumn(
        "observed", F.coalesce((F.col("topic") == "a") & (F.col("partition") == 1), F.lit(False)))
    rows = codec.encode_topics(flagged, 1, observed_only=True).collect()
    assert [r.key for r in rows] == ["a"] and set(json.loads(rows[0].value)["partitions"]) == {"0", "1"}


def test_replay_replaces_between_runs(spark):
    first = log(spark, [("topic-a", record("topic-a", {0: offset_only(100)})), ("topic-b", record("topic-b", {0: offset_only(200)}))])
    assert set(folds.of_state(replay.replay_topics(first, 1))) == {"topic-a", "topic-b"}


@pytest.mark.parametrize("existing,incoming,expected", [
    ({}, {0: (10, 0)}, {0: 10}), ({0: (50, 0), 1: (60, 0)}, {2: (100, 0), 3: (200, 0)}, {0: 50, 1: 60, 2: 100, 3: 200}),
    ({0: (50, 0)}, {0: (100, 0)}, {0: 100}), ({1: (10, 0)}, {0: (20, 0)}, {0: 20, 1: 10}),
    ({0: (50, 9)}, {0: (100, 8)}, {0: 50}), ({0: (50, 9)}, {}, {0: 50})])
def test_state_merge(spark, existing, incoming, expected):
    def of(parts, update):
        rows = [("t", p, o, 1, False, s, 0, update) for p, (o, s) in parts.items()]
        return spark.createDataFrame(rows, STATE)
    merged = folds.of_state(replay.merge_states(of(existing, 5), of(incoming, 7)), with_update=True)
    update, parts = merged["t"]
    assert {p: f[0] for p, f in parts.items()} == expected
    assert update == (7 if incoming else 5)


def test_state_merge_keeps_fresher_emptiness(spark):
    old = spark.createDataFrame([("t", p, 5, 1, True, NOW, 0, 1) for p in (0, 1)], STATE)
    new = spark.createDataFrame([("t", p, 5, 1, False, NOW - 300, 0, 1) for p in (0, 1)]
                                + [("t", p, 5, 1, True, NOW, 0, 1) for p in (2, 3)], STATE)
    parts = folds.of_state(replay.merge_states(old, new))["t"]
    assert len(parts) == 4 and all(f[2] for f in parts.values()) and all(f[3] == NOW for f in parts.values())


COUNTERS = ["total_records", "duplicate_key_records", "tombstone_records", "heartbeat_records", "malformed_records",
            "unique_keys", "final_topics", "final_instances", "discarded_records"]


def test_profile(spark):
    orders = ("orders", record("orders", {0: offset_only(1)}))
    row = profile.changelog_profile(log(spark, [orders, orders, ("orders", None)])).first()
    assert [row[c] for c in COUNTERS] == [3, 2, 1, 0, 0, 1, 0, 0, 3]
    mixed = [beat("i-1"), ("tracker-instance:i-1", BROKEN), ("broken-topic", BROKEN), ("payments", record("payments", {}))]
    row = profile.changelog_profile(log(spark, mixed)).first()
    assert [row[c] for c in COUNTERS] == [4, 1, 0, 2, 2, 3, 1, 1, 2]
    empty = profile.changelog_profile(log(spark, [])).first()
    assert [empty[c] for c in COUNTERS] == [0] * 9
    assert profile.key_mismatches(log(spark, [("x", record("y", {})), ("y", record("y", {}))])).first()[0] == 1
    assert profile.approximate_unique_keys(log(spark, mixed)).first()[0] == 3


def test_resume_offsets(spark):
    rows = spark.createDataFrame([("a", None, 0, 4, None), ("b", None, 0, 7, None), ("c", None, 2, 0, None)], CHANGELOG)
    assert {tuple(r) for r in profile.resume_offsets(rows, 4).collect()} == {(0, 8), (1, 0), (2, 1), (3, 0)}
    text = log_source.starting_offsets_json("log", profile.resume_offsets(rows), 4)
    assert json.loads(text) == {"log": {"0": 8, "1": -1, "2": 1, "3": -1}}


def heartbeats(spark, records):
    return replay.replay_heartbeats(log(spark, records))


def test_heartbeats(spark):
    row = heartbeats(spark, [beat("inst-2", shards=3, group="tracker-scan")]).first()
    assert (row.instance_id, row.assigned_shards, row.group_id, row.scan_interval_sec) == ("inst-2", 3, "tracker-scan", 0)
    assert heartbeats(spark, [beat("inst-2"), ("tracker-instance:inst-2", None)]).count() == 0
    assert heartbeats(spark, [beat("inst-2"), beat("inst-3"), beat("inst-1")]).count() == 3
    kept = heartbeats(spark, [beat("i", last=5), ("tracker-instance:i", BROKEN)]).first()
    assert kept.last_heartbeat_at == 5


def test_expired_instances(spark):
    beats = heartbeats(spark, [beat("a", NOW - 90), beat("b", NOW - 91), beat("c", NOW - 90, 0), beat("d", 0)])
    assert {r.instance_id for r in instances.live_instances(beats, NOW).collect()} == {"a", "c"}
    gone = codec.instance_tombstones(instances.expired_instances(beats, NOW)).collect()
    assert {(r.key, r.value) for r in gone} == {("tracker-instance:b", None), ("tracker-instance:d", None)}


def test_heartbeat_round_trip(spark):
    rows = [("i", 5, 30, 60, "g", 2), ("j", 6, 0, 0, "", 0)]
    encoded = codec.encode_heartbeats(spark.createDataFrame(rows, HEARTBEAT))
    values = {r.key: r.value for r in encoded.collect()}
    assert values["tracker-instance:j"] == '{"version":1,"instance_id":"j","last_heartbeat_at":6,"heartbeat_interval_sec":0}'
    back = heartbeats(spark, list(values.items()))
    assert {tuple(r) for r in back.select(*HEARTBEAT.names).collect()} == set(rows)


def findings(spark, configs):
    rows = [("t", k, v) for k, v in configs.items()]
    frame = topic_configs(spark.createDataFrame(rows, "topic string, name string, value string"))
    return {(r.name, r.severity, r.problem) for r in audit.config_findings(frame).collect()}


def test_config_audit(spark):
    assert findings(spark, {"cleanup.policy": "delete", "segment.ms": "1"}) == {("cleanup.policy", "error", "not compacted")}
    assert findings(spark, {"cleanup.policy": None, "segment.ms": "1"}) == {("cleanup.policy", "error", "not set")}
    assert findings(spark, {"cleanup.policy": "compact", "segment.ms": "2048"}) == {
        ("segment.ms", "warning", "mismatch"), ("min.cleanable.dirty.ratio", "warning", "not set"),
        ("retention.ms", "warning", "not set"), ("retention.bytes", "warning", "not set")}
    named = spark.createDataFrame([("t", "a", "1"), ("t", "b", "2"), ("t", "c", None)], "topic string, name string, value string")
    assert {r.name for r in topic_configs(named, ["a", "c"]).collect()} == {"a"}


def test_kafka_layout(spark):
    raw = spark.createDataFrame([(bytearray(b"k"), bytearray(b""), 1, 2, None), (None, None, 1, 3, None)],
                                "key binary, value binary, partition int, offset long, timestamp timestamp")
    rows = log_source.normalise(raw).collect()
    assert (rows[0].key, rows[0].value, rows[1].key, rows[1].value) == ("k", "", "", None)


def test_utc_text(spark):
    assert spark.range(1).select(utc_text(F.lit(0)).alias("x")).first().x == "1970-01-01T00:00:00Z"


def test_kafka_sources_reach_the_connector(spark):
    """Without the connector on the class path the lookup of the source fails, not the options."""
    frame = spark.createDataFrame([("k", "v")], "key string, value string")
    for call in (lambda: log_source.from_kafka(spark, "host:1", "log", maxOffsetsPerTrigger="10"),
                 lambda: log_source.stream_kafka(spark, "host:1", "log", '{"log":{"0":1}}'),
                 lambda: log_source.append_to_kafka(frame, "host:1", "log")):
        with pytest.raises(Exception, match="(?i)kafka"):
            call()
