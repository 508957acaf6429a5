"""Live views of the changelog.

Each view is a table kept as changes (``store``): a micro-batch reads the rows of the keys it
touches, folds its records into them and writes what changed.  The checkpoint of the
query carries the read position, so a restart reads on without a gap and without
reading twice.  The records of one key must arrive in the order of their offsets, as one
changelog partition gives them.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quietlog.operators.codec import decode, heartbeat_fields
from quietlog.operators.instances import with_liveness
from quietlog.operators.replay import ROW, alive_rows, fold_alive, folded_state, last_tombstones
from quietlog.schema import HEARTBEAT, PARTITION_FIELDS
from quietlog.sources.tables import Scratch
from quietlog.streaming.store import COMPACT_EVERY, ChangeStore, same_keys

Fold = Callable[[DataFrame, int], None]

_FOLDED = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("row", ROW),
    T.StructField("seq", T.LongType()),
    T.StructField("last_record", T.StructType([
        T.StructField("seq", T.LongType()), T.StructField("written_at", T.LongType())])),
])
_BEAT = T.StructType([*HEARTBEAT.fields, T.StructField("seq", T.LongType())])


def _start(frame: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (frame.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


# -- topics ------------------------------------------------------------------------------

def _topics(path: str, every: int = COMPACT_EVERY) -> ChangeStore:
    return ChangeStore(path, _FOLDED, ("topic", "partition"), every)


def folded_from(state: DataFrame) -> DataFrame:
    """A state table as the start of a view: older than every record of the tail."""
    row = F.struct(*[F.col(name) for name in ROW.names]).alias("row")
    mark = F.struct(F.lit(-1).cast("bigint").alias("seq"), F.coalesce("last_update", F.lit(0)).alias("written_at"))
    first = F.lit(-1).cast("bigint").alias("seq")
    rows = state.where(F.col("partition").isNotNull()).select("topic", "partition", row, first, mark.alias("last_record"))
    markers = state.groupBy("topic").agg(F.max("last_update").alias("last_update")).select(
        "topic", F.lit(None).cast("int").alias("partition"), F.lit(None).cast(ROW).alias("row"), first, mark.alias("last_record"))
    return rows.unionByName(markers)


def _fold_topics(batch: DataFrame, store: ChangeStore, batch_id: int) -> None:
    spark, seq, before = batch.sparkSession, F.col("offset"), batch_id - 1
    with Scratch() as scratch:
        cleared = scratch.table(last_tombstones(batch, seq), "tombstones")
        arrived = scratch.table(fold_alive(alive_rows(batch, cleared, seq)).withColumn("partition", F.col("row.partition")), "arrived")
        held = store.read(spark, before, touched=arrived.select("topic", "partition")).drop("version").join(cleared, "topic", "left_anti")
        fresh = fold_alive(held.unionByName(arrived)).withColumn("partition", F.col("row.partition"))
        # A deletion takes all rows of its topic that have not come again.
        gone = same_keys(store.read(spark, before, touched=cleared.select("topic")).drop("version"), arrived, ["topic", "partition"], "left_anti")
        store.write(fresh.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True))), batch_id)


def topic_fold(path: str, initial: DataFrame | None = None, compact_every: int = COMPACT_EVERY) -> Fold:
    """Folds batches of the changelog, numbered from 0, into the topic view under ``path``.

    ``initial`` is a replayed state from whose resume offsets the batches read on.
    """
    store = _topics(path, compact_every)

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch_id == 0 and initial is not None:
                store.start(folded_from(initial))
            _fold_topics(batch, store, batch_id)
        finally:
            batch.unpersist()
    return fold


def topic_view(changelog: DataFrame, path: str, checkpoint: str, initial: DataFrame | None = None,
               compact_every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Keep the merged topic view of a changelog stream under ``path`` by ``topic_fold``."""
    return _start(changelog, topic_fold(path, initial, compact_every), checkpoint, trigger)


def read_topic_view(spark: SparkSession, path: str) -> DataFrame:
    """The state table of ``topic_view``, with markers."""
    return folded_state(_topics(path).read(spark))


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """The partition rows of ``topic_view``."""
    rows = _topics(path).read(spark).where(F.col("partition").isNotNull())
    return rows.select("topic", "partition", *[F.col(f"row.{name}").alias(name) for name in PARTITION_FIELDS])


# -- heartbeats --------------------------------------------------------------------------

def _beats(path: str, every: int = COMPACT_EVERY) -> ChangeStore:
    return ChangeStore(path, _BEAT, ("instance_id",), every)


def last_heartbeats(changelog: DataFrame) -> DataFrame:
    """The last valid heartbeat or tombstone of every instance (R2); malformed records do not take part."""
    records = decode(changelog).where(F.col("instance_id").isNotNull())
    seq = F.when(F.col("is_valid"), F.col("offset"))
    return records.groupBy("instance_id").agg(
        F.max_by(F.struct("is_tombstone", "heartbeat"), seq).alias("last"), F.max(seq).alias("seq")
    ).where(F.col("last").isNotNull()).select(
        *heartbeat_fields(F.col("last.heartbeat"), F.col("instance_id")), "seq", F.col("last.is_tombstone").alias("deleted"))


def heartbeat_fold(path: str, initial: DataFrame | None = None, compact_every: int = COMPACT_EVERY) -> Fold:
    """Folds batches of the changelog, numbered from 0, into the known instances under ``path`` (R2).

    ``initial`` are the instances of a replayed log (``replay_heartbeats``), so that a tail that
    starts at its resume offsets knows them.  Deleted instances leave the table with the
    next compaction.
    """
    store = _beats(path, compact_every)

    def fold(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0 and initial is not None:
            store.start(initial.withColumn("seq", F.lit(-1).cast("bigint")))
        store.write(last_heartbeats(batch), batch_id)
    return fold


def heartbeat_view(changelog: DataFrame, path: str, checkpoint: str, initial: DataFrame | None = None,
                   compact_every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Keep the known instances of a changelog stream under ``path`` by ``heartbeat_fold``."""
    return _start(changelog, heartbeat_fold(path, initial, compact_every), checkpoint, trigger)


def read_heartbeat_view(spark: SparkSession, path: str, as_of) -> DataFrame:
    """Known instances; liveness is evaluated now, expired ones stay listed as inactive."""
    return with_liveness(_beats(path).read(spark).select(*HEARTBEAT.names), as_of)
