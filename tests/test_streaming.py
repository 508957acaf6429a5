"""Streams equal their batch forms for any split, across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from quietlog.operators import profile, replay
from quietlog.schema import CHANGELOG, STATE
from quietlog.sources import changelog as log_source
from quietlog.streaming import live, scans, tail
from quietlog.streaming.store import ChangeStore
from tests import folds
from tests.test_changelog import BROKEN, beat, log, random_records, record, offset_only
from tests.test_scans import listing, observations, random_scans


def cut(items, parts, seed):
    marks = sorted(random.Random(seed).sample(range(1, len(items)), parts - 1))
    return [items[a:b] for a, b in zip([0, *marks], [*marks, len(items)])]


def feed(spark, tmp_path, records, parts, start, read):
    """Append the records part by part; every run of the query restarts from its checkpoint."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("source", "out", "checkpoint"))
    numbered = list(enumerate(records))
    results = []
    for part in cut(numbered, parts, 3) if parts > 1 else [numbered]:
        rows = [(key, value, 0, i, None) for i, (key, value) in part]
        spark.createDataFrame(rows, CHANGELOG).repartition(3).write.mode("append").parquet(source)
        query = start(log_source.stream_table(spark, source), out, checkpoint)
        query.awaitTermination()
        results.append((query, read(spark, out)))
    return results


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_table_view_equals_merge(spark, tmp_path, parts):
    records = random_records(11, 300)
    view = feed(spark, tmp_path, records, parts, live.topic_view, live.read_topic_view)[-1][1]
    assert folds.of_state(view, with_update=True) == folds.merge(records)


@pytest.mark.parametrize("parts,every", [(3, 1), (6, 2), (5, 4)])
def test_compacted_view_equals_merge(spark, tmp_path, parts, every):
    records = random_records(12, 240)
    def start(stream, out, checkpoint):
        return live.topic_view(stream, out, checkpoint, compact_every=every)
    view = feed(spark, tmp_path, records, parts, start, live.read_partitions)[-1][1]
    rows = folds.of_state(view.withColumn("last_update", F.lit(0)))
    assert rows == {topic: held for topic, (_, held) in folds.merge(records).items() if held}


def test_tombstone_is_emitted_as_deleted_rows(spark, tmp_path):
    big = 2**60 + 1
    records = [("t", record("t", {0: offset_only(big), 1: offset_only(2)})), ("u", record("u", {0: offset_only(3)})),
               ("t", None), ("t", record("t", {1: offset_only(4)}))]
    feed(spark, tmp_path, records[:2], 1, live.topic_view, live.read_partitions)
    out = str(tmp_path / "out")
    assert {r.offset for r in live.read_partitions(spark, out).collect()} == {big, 2, 3}
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    later = spark.createDataFrame([(k, v, 0, i + 2, None) for i, (k, v) in enumerate(records[2:])], CHANGELOG)
    later.write.mode("append").parquet(source)
    live.topic_view(log_source.stream_table(spark, source), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(f"{out}/batch_id=1").collect()  # what the batch changed, and nothing of "u"
    assert {(r.topic, r.partition, r.deleted) for r in rows} == {("t", None, False), ("t", 0, True), ("t", 1, False)}


def test_heartbeat_view(spark, tmp_path):
    now = 1774864800
    records = [beat("a", now), beat("b", now - 500), ("t", record("t", {})), beat("c", now), ("tracker-instance:a", BROKEN),
               ("tracker-instance:c", None), ("tracker-instance:d", BROKEN)]
    view = feed(spark, tmp_path, records, 3, live.heartbeat_view,
                lambda s, out: live.read_heartbeat_view(s, out, now))[-1][1]
    assert {(r.instance_id, r.is_active) for r in view.collect()} == {("a", True), ("b", False)}
    kept = replay.replay_heartbeats(log(spark, records)).select("instance_id").collect()
    assert {r.instance_id for r in kept} == {"a", "b"}


def test_table_view_starts_from_a_replayed_state(spark, tmp_path):
    records = random_records(13, 200)
    numbered = [(key, value, 0, i, None) for i, (key, value) in enumerate(records)]
    initial = replay.merge_topics(spark.createDataFrame(numbered[:120], CHANGELOG))
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    for part in (numbered[120:160], numbered[160:]):
        spark.createDataFrame(part, CHANGELOG).write.mode("append").parquet(source)
        live.topic_view(log_source.stream_table(spark, source), out, checkpoint, initial=initial).awaitTermination()
    assert folds.of_state(live.read_topic_view(spark, out), with_update=True) == folds.merge(records)


def test_a_tail_by_offset_has_no_gap_and_reads_nothing_twice(spark, tmp_path):
    records = random_records(15, 200)
    out, positions, source = (str(tmp_path / n) for n in ("out", "positions", "source"))
    keys = sorted({key for key, _ in records})
    numbered, at = [], [0, 0, 0]
    for key, value in records:
        p = keys.index(key) % 3
        numbered.append((key, value, p, at[p], None))
        at[p] += 1 + (at[p] % 50 == 49) * 30  # gaps, as compaction leaves them
    frame = lambda rows: spark.createDataFrame(rows, CHANGELOG)
    first = [r for r in numbered[:60] if r[2] < 2]  # the replay does not know partition 2
    frame(numbered[:120]).repartition(2).write.parquet(source)
    seen = []
    inner = live.topic_fold(out, replay.merge_topics(frame(first)), compact_every=2)

    def fold(batch, step):
        seen.extend((r.partition, r.offset) for r in batch.collect())
        inner(batch, step)
        if step == 2 and len(failed) < 1:
            failed.append(step)
            raise RuntimeError("lost before the position is noted")
    failed = []
    resume = profile.resume_offsets(frame(first))
    with pytest.raises(RuntimeError):
        tail.follow(log_source.from_table(spark, source), positions, fold, resume, per_partition=9)
    again = len(seen)
    tail.follow(log_source.from_table(spark, source), positions, fold, resume, per_partition=9, steps=1)
    repeated = seen[again:]
    assert set(repeated) <= set(seen[:again])  # the failed step is taken once more
    frame(numbered[120:]).write.mode("append").parquet(source)
    assert tail.follow(log_source.from_table(spark, source), positions, fold, per_partition=25) > 2
    assert tail.follow(log_source.from_table(spark, source), positions, fold) == 0
    once = seen[:again] + seen[again + len(repeated):]
    assert sorted(once) == sorted((r[2], r[3]) for r in numbered if r not in first)
    assert folds.of_state(live.read_topic_view(spark, out), with_update=True) == folds.merge(records)
    assert {r.partition: r.next_offset for r in tail.read_positions(spark, positions).collect()} == {
        p: max(r[3] for r in numbered if r[2] == p) + 1 for p in range(3)}


def test_deleted_instances_leave_the_table(spark, tmp_path):
    now = 1774864800
    records = [beat("a", now), beat("b", now), ("tracker-instance:b", None), beat("c", now - 500), beat("a", now - 1), beat("d", now),
               ("tracker-instance:d", None), beat("e", now)]

    def start(stream, out, checkpoint):
        return live.heartbeat_view(stream, out, checkpoint, compact_every=2)
    view = feed(spark, tmp_path, records, 8, start, lambda s, out: live.read_heartbeat_view(s, out, now))[-1][1]
    assert sorted((r.instance_id, r.last_heartbeat_at) for r in view.collect()) == [("a", now - 1), ("c", now - 500), ("e", now)]
    out = tmp_path / "out"
    assert sorted(p.name for p in out.iterdir()) == ["base=5", "base=7", "batch_id=6", "batch_id=7"]  # older ones are deleted
    assert sorted(r.instance_id for r in spark.read.parquet(str(out / "base=7")).collect()) == ["a", "c", "e"]


def test_heartbeats_start_from_replayed_instances(spark, tmp_path):
    now = 1774864800
    early = [beat("a", now - 9), beat("b", now), beat("c", now - 500)]
    initial = replay.replay_heartbeats(log(spark, early))
    late = [beat("a", now), ("tracker-instance:b", None), ("tracker-instance:x", None)]

    def start(stream, out, checkpoint):
        return live.heartbeat_view(stream, out, checkpoint, initial=initial)
    view = feed(spark, tmp_path, late, 2, start, lambda s, out: live.read_heartbeat_view(s, out, now))[-1][1]
    assert sorted((r.instance_id, r.last_heartbeat_at) for r in view.collect()) == [("a", now), ("c", now - 500)]


def test_what_a_batch_writes_does_not_grow_with_the_state(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    many = [(f"t{i}", record(f"t{i}", {p: offset_only(p) for p in range(20)})) for i in range(100)]
    for n, part in enumerate((many, [("t5", record("t5", {3: offset_only(9)}))])):
        rows = [(key, value, 0, 1000 * n + i, None) for i, (key, value) in enumerate(part)]
        spark.createDataFrame(rows, CHANGELOG).write.mode("append").parquet(source)
        live.topic_view(log_source.stream_table(spark, source), out, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{out}/batch_id=0").count() == 2100 and spark.read.parquet(f"{out}/batch_id=1").count() == 2
    assert live.read_partitions(spark, out).count() == 2000


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    store = ChangeStore(str(tmp_path / "table"), STATE, ("topic", "partition"), every=2)
    row = lambda p, offset: ("t", p, offset, 1, False, 1, 1, None)
    frame = lambda rows: spark.createDataFrame(rows, STATE)
    for n in range(5):
        for _ in range(2):
            store.write(frame([row(None, n), row(n, n)]), n)
        held = {(r.partition, r.offset) for r in store.read(spark).collect()}
        assert held == {(None, n), *((p, p) for p in range(n + 1))}
        assert {(r.partition, r.offset) for r in store.read(spark, n - 1).collect()} == ({(None, n - 1), *((p, p) for p in range(n))} if n else set())
    assert store.last_batch(spark) == 4
    gone = frame([row(2, 0)]).withColumn("deleted", F.lit(True))
    assert {r.partition for r in store.read(spark, then=[gone]).collect()} == {None, 0, 1, 3, 4}
    touched = spark.createDataFrame([(None,), (3,)], "partition int")
    assert {r.partition for r in store.read(spark, touched=touched).collect()} == {None, 3}


def test_changes_are_only_joined_with_a_base(spark, tmp_path):
    store = ChangeStore(str(tmp_path / "table"), STATE, ("topic", "partition"), every=3)
    for n in range(3):
        plan = store.read(spark, n - 1)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan  # nothing that would gather all rows for a base that is not there
        store.write(spark.createDataFrame([("t", p, n, 1, False, 1, 1, None) for p in (0, n)], STATE), n)
        assert {(r.partition, r.offset) for r in store.read(spark).collect()} == {(0, n), *((p, p) for p in range(1, n + 1))}
    assert "Join" in store.read(spark, then=[spark.createDataFrame([], STATE)])._jdf.queryExecution().executedPlan().toString()


def test_a_used_folder_is_refused(spark, tmp_path):
    records = random_records(14, 40)
    feed(spark, tmp_path, records, 3, live.topic_view, live.read_topic_view)
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    again = live.topic_view(log_source.stream_table(spark, source), out, str(tmp_path / "other"))
    with pytest.raises(Exception, match="another query"):
        again.awaitTermination()


def scan_table(spark, rows):
    sizes = {}
    for _, _, time, _ in rows:
        sizes[time] = sizes.get(time, 0) + 1
    return spark.createDataFrame([(t, p, time, True, offset, 0, sizes[time]) for t, p, time, offset in rows], scans.SCAN_ROW)


def test_split_scans_wait_and_late_ones_are_refused(spark, tmp_path):
    source, state, changelog, checkpoint = (str(tmp_path / n) for n in ("source", "state", "log", "checkpoint"))
    topics = [f"t{i}" for i in range(8)]
    first = scan_table(spark, [(t, 0, 1000, 5) for t in topics])
    second = scan_table(spark, [(t, 0, 2000, 9) for t in topics])
    late = scan_table(spark, [(t, 0, 1500, 7) for t in topics[:2]])

    def run(frame):
        frame.coalesce(1).write.mode("append").parquet(source)
        scans.start_scans(scans.read_scans(spark, source, max_files_per_trigger=1), state, changelog, checkpoint).awaitTermination()
        return {t: held[0][0] for t, held in folds.of_state(scans.read_scan_state(spark, state)).items()}

    half = F.col("topic") < "t4"
    assert run(first.where(half)) == {}
    assert run(second) == {}  # complete, but an earlier scan is not
    assert run(first.where(~half)) == dict.fromkeys(topics, 9)
    records = scans.read_scan_changelog(spark, changelog).collect()
    assert len(records) == 16 and all(r.value for r in records)  # a set of records for each scan, no tombstone
    assert run(late) == dict.fromkeys(topics, 9)
    assert scans.read_scan_changelog(spark, changelog).count() == 16


def test_an_incomplete_scan_is_given_up(spark, tmp_path):
    source, state, changelog, checkpoint = (str(tmp_path / n) for n in ("source", "state", "log", "checkpoint"))
    now = [100]

    def run(rows, lost=(), **options):
        frame = scan_table(spark, rows).where(~F.col("topic").isin(*lost, "-"))
        frame.unionByName(frame).write.mode("append").parquet(source)  # read twice: counts once
        scans.start_scans(scans.read_scans(spark, source), state, changelog, checkpoint, clock=lambda: now[0], **options).awaitTermination()
        held = {t: held[0][0] for t, held in folds.of_state(scans.read_scan_state(spark, state)).items()}
        return held, {r.scan_time: r.status for r in scans.read_scan_ledger(spark, state).collect()}

    both = lambda time, offset: [("a", 0, time, offset), ("b", 0, time, offset)]
    assert run(both(1000, 1), lost=["b"]) == ({}, {1000: "waiting"})
    assert run(both(2000, 2)) == ({}, {1000: "waiting", 2000: "waiting"})
    held, ledger = run(both(3000, 3))
    assert held == {"a": 3, "b": 3} and ledger == {1000: "given up", 2000: "folded", 3000: "folded"}
    assert run(both(1000, 9))[0] == held  # late rows of it are refused
    assert spark.read.parquet(f"{state}-waiting").count() == 0
    # by time: nothing later is complete, but the limit has passed
    assert run(both(4000, 4), lost=["a"], max_wait=60)[1][4000] == "waiting"
    now[0] += 59
    assert run(both(5000, 5), lost=["a"], max_wait=60)[1] == {**ledger, 4000: "waiting", 5000: "waiting"}
    now[0] += 1
    assert run(both(6000, 6), max_wait=60)[1] == {**ledger, 4000: "given up", 5000: "waiting", 6000: "waiting"}
    assert run([("a", 0, 5000, 5)])[0] == {"a": 6, "b": 6}
    assert len(list((tmp_path / "state-waiting").glob("batch_id=*"))) == 2


def test_scans_start_from_a_state(spark, tmp_path):
    source, state, changelog, checkpoint = (str(tmp_path / n) for n in ("source", "state", "log", "checkpoint"))
    initial = spark.createDataFrame([("a", 0, 5, 700, False, 1000, 5, 1000), ("b", 0, 5, 700, False, 1000, 5, 1000)], STATE)
    scan_table(spark, [("a", 0, 900, 1), ("a", 0, 2000, 5)]).write.parquet(source)
    scans.start_scans(scans.read_scans(spark, source), state, changelog, checkpoint, initial=initial).awaitTermination()
    rows = scans.read_scan_state(spark, state).where("partition is not null").collect()
    assert [(r.topic, r.offset, r.timestamp, r.scanned_at) for r in rows] == [("a", 5, 700, 2000)]
    assert {(r.key, r.value is None) for r in scans.read_scan_changelog(spark, changelog).collect()} == {("a", False), ("b", True)}


@pytest.mark.parametrize("seed,parts", [(21, 1), (22, 4)])
def test_scan_stream(spark, tmp_path, seed, parts):
    series = [(time, {t: p for t, p in listed.items() if p}, answers) for time, listed, answers in random_scans(seed, 10)]
    source, state, changelog, checkpoint = (str(tmp_path / n) for n in ("source", "state", "log", "checkpoint"))
    done = []
    for part in cut(series, parts, seed) if parts > 1 else [series]:
        scans.scan_rows(listing(spark, part), observations(spark, part)).write.mode("append").parquet(source)
        query = scans.start_scans(scans.read_scans(spark, source), state, changelog, checkpoint)
        query.awaitTermination()
        done += part
        expected = folds.fold_scans(done)
        assert folds.of_state(scans.read_scan_state(spark, state), with_update=True) == expected
        replayed = folds.of_state(replay.replay_topics(scans.read_scan_changelog(spark, changelog), 1))
        assert replayed == {topic: held for topic, (_, held) in expected.items()}
        merged = folds.of_state(replay.merge_topics(scans.read_scan_changelog(spark, changelog)))
        assert merged == replayed
    answered = sum(offsets[0] is not None for _, _, answers in done[-len(part):] for ps in answers.values() for offsets in ps.values())
    assert query.lastProgress["observedMetrics"]["scan"]["processed_partitions"] == answered
