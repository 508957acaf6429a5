"""Periodic scans as a stream.

The stream has one row per listed partition and scan: topic, partition, scan_time,
``asked`` (false where the topic gave no answer at all), latest, earliest, and
``expected``, the number of rows of the scan.  A scan counts only when all its rows have
arrived: until then it is held back, and so are later scans.

A scan may never become complete, as a scan that fails half way does.  It is given up when
``patience`` later scans are complete, or when ``max_wait`` seconds have gone by since its first row
came; later scans go on from the state before it, and rows of it that come late are
refused.  The ledger says of every scan whether it was folded, was given up, or is waiting.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quietlog.functions.names import is_system_topic
from quietlog.functions.sharding import shard
from quietlog.operators.codec import encode_topics, topic_of, topic_tombstones
from quietlog.operators.history import ScansFold, fold_scans
from quietlog.schema import CHANGELOG, DEFAULT_SHARDS, STATE
from quietlog.sources.tables import Scratch
from quietlog.streaming.sinks import drop_batches, read_batch, write_batch
from quietlog.streaming.store import COMPACT_EVERY, ChangeStore

SCAN_ROW = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("scan_time", T.LongType()),
    T.StructField("asked", T.BooleanType()),
    T.StructField("latest", T.LongType()),
    T.StructField("earliest", T.LongType()),
    T.StructField("expected", T.LongType()),
])
LEDGER = T.StructType([
    T.StructField("scan_time", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("partitions", T.LongType()),
    T.StructField("expected", T.LongType()),
    T.StructField("first_seen", T.LongType()),
])
FOLDED, GIVEN_UP, WAITING, START = "folded", "given up", "waiting", "start"


def scan_rows(listing: DataFrame, observations: DataFrame) -> DataFrame:
    """Listing and observations as rows of the scan stream."""
    sizes = listing.where(~is_system_topic(F.col("topic"))).groupBy("scan_time").agg(F.count(F.lit(1)).alias("expected"))  # one row per scan
    answers = observations.select("topic", "partition", "scan_time", F.lit(True).alias("asked"), "latest", "earliest")
    return (
        listing.join(answers, ["topic", "partition", "scan_time"], "left")
        .withColumn("asked", F.coalesce("asked", F.lit(False)))
        .join(sizes, "scan_time")
        .select(*SCAN_ROW.names)
    )


def read_scans(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCAN_ROW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _log_columns(records: DataFrame) -> DataFrame:
    """Place records in a table-backed log, scan by scan: a tombstone just before the new record."""
    return records.select(
        "key", "value",
        shard(topic_of(F.col("key")), F.lit(0), DEFAULT_SHARDS).alias("partition"),
        (F.col("scan_time") * 2 + F.col("value").isNotNull().cast("bigint")).alias("offset"),
        F.timestamp_seconds("scan_time").alias("timestamp"))


@dataclass(frozen=True)
class Progress:
    """One scan of the ledger."""

    scan_time: int
    status: str
    partitions: int
    expected: int
    first_seen: int


def decide(scans: list[Progress], patience: int, max_wait: int | None, now: int) -> list[Progress]:
    """What becomes of the scans that have arrived in part or whole, given in the order of time.

    Complete scans are folded up to the first incomplete one that is still waited for.
    """
    waited_for, out = False, []
    for i, scan in enumerate(scans):
        later = sum(s.partitions >= s.expected for s in scans[i + 1:])
        overdue = later >= patience or (max_wait is not None and now - scan.first_seen >= max_wait)
        if scan.partitions < scan.expected:
            status = WAITING if waited_for or not overdue else GIVEN_UP
        else:
            status = WAITING if waited_for else FOLDED
        waited_for |= status == WAITING
        out.append(Progress(scan.scan_time, status, scan.partitions, scan.expected, scan.first_seen))
    return out


def _ledger(path: str, every: int) -> ChangeStore:
    return ChangeStore(f"{path.rstrip('/')}-ledger", LEDGER, ("scan_time",), every)


def _state(path: str, every: int = COMPACT_EVERY) -> ChangeStore:
    return ChangeStore(path, STATE, ("topic", "partition"), every)


def _arrived(rows: DataFrame, ledger: DataFrame, now: int) -> list[Progress]:
    """Scans with rows that may still count; one row per scan that waits comes to the driver."""
    settled = ledger.agg(F.max(F.when(F.col("status").isin(FOLDED, START), F.col("scan_time")))).first()[0]
    known = {r["scan_time"]: r for r in ledger.where(
        F.lit(settled is None) | (F.col("scan_time") > F.lit(settled))).collect()}
    scans = rows.groupBy("scan_time").agg(F.count(F.lit(1)).alias("partitions"), F.max("expected").alias("expected")).collect()
    out = []
    for scan in sorted(scans, key=lambda r: r["scan_time"]):
        before = known.get(scan["scan_time"])
        if (settled is not None and scan["scan_time"] <= settled) or (before and before["status"] == GIVEN_UP):
            continue  # overtaken, or late
        out.append(Progress(scan["scan_time"], WAITING, scan["partitions"], scan["expected"], before["first_seen"] if before else now))
    return out


def _records(fold: ScansFold, before: DataFrame) -> DataFrame:
    """(key, value, scan_time) of what each scan writes: the topics with observed rows, and tombstones."""
    written = encode_topics(fold.versions, F.col("scan_time"), observed_only=True, versions=["scan_time"])
    known = before.select("topic", "partition").unionByName(fold.versions.select("topic", "partition"))
    return written.select("key", "value", "scan_time").unionByName(topic_tombstones(fold.ended, known, versions=["scan_time"]))


def start_scans(scans: DataFrame, state_path: str, changelog_path: str, checkpoint: str,
                initial: DataFrame | None = None, patience: int = 2, max_wait: int | None = None,
                compact_every: int = COMPACT_EVERY, clock: Callable[[], float] = time.time, **trigger) -> StreamingQuery:
    """Fold every micro-batch of scans into the state and write changelog records.

    A batch may complete several scans (catching up); they are folded in one pass, and each writes
    its own set of records.
    The state is kept as changes, so a scan writes the rows it observed.  Rows of
    incomplete scans wait in a table beside it, each once however often it was read.  ``initial`` is
    the state to start from, such as a replayed log; scans up to its last one are refused, as are scans
    that a later one has overtaken.  Batches never overlap, and ``availableNow`` gives the
    one-shot form.  The counters of A11 are reported as the observed metrics ``scan`` of
    the query; they count rows before completeness is known.
    """
    waiting_path = f"{state_path.rstrip('/')}-waiting"
    store, ledger = _state(state_path, compact_every), _ledger(state_path, compact_every)
    scans = scans.where(~is_system_topic(F.col("topic"))).observe(
        "scan",
        F.count(F.lit(1)).alias("listed_partitions"),
        F.count_if("asked").alias("asked_partitions"),
        F.count("latest").alias("processed_partitions"))

    def begin(spark: SparkSession) -> None:
        store.start(initial.select(*STATE.names))
        last = initial.agg(F.max(F.greatest("scanned_at", "last_update"))).first()[0]
        if last is not None:
            ledger.start(spark.createDataFrame([(last, START, 0, 0, 0)], LEDGER))

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0 and initial is not None:
            begin(spark)
        with Scratch() as scratch:
            waiting = read_batch(spark, waiting_path, batch_id - 1, SCAN_ROW)
            # A row that is read twice counts once.
            rows = scratch.table(waiting.unionByName(batch).dropDuplicates(["scan_time", "topic", "partition"]), "scan-rows")
            found = decide(_arrived(rows, ledger.read(spark, batch_id - 1), int(clock())), patience, max_wait, int(clock()))
            times = [s.scan_time for s in found if s.status == FOLDED]
            if times:
                before, due = store.read(spark, batch_id - 1).drop("version"), rows.where(F.col("scan_time").isin(times))
                result = fold_scans(before, due, due.where("asked"), times, scratch.table)
                write_batch(_log_columns(_records(result, before)), changelog_path, batch_id)
                store.write(result.changed, batch_id)
            else:
                store.write(spark.createDataFrame([], STATE), batch_id)
            held = [s.scan_time for s in found if s.status == WAITING]
            write_batch(rows.where(F.col("scan_time").isin(held)), waiting_path, batch_id)
            ledger.write(spark.createDataFrame([tuple(vars(s).values()) for s in found], LEDGER), batch_id)
            drop_batches(spark, waiting_path, batch_id - 1)

    return (scans.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_scan_state(spark: SparkSession, state_path: str) -> DataFrame:
    """State table after the newest batch."""
    return _state(state_path).read(spark).select(*STATE.names)


def read_scan_ledger(spark: SparkSession, state_path: str) -> DataFrame:
    """What became of every scan."""
    return _ledger(state_path, COMPACT_EVERY).read(spark).select(*LEDGER.names)


def read_scan_changelog(spark: SparkSession, changelog_path: str) -> DataFrame:
    """All records the scans have written."""
    return spark.read.schema(CHANGELOG).parquet(f"{changelog_path}/batch_id=*")
