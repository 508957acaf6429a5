"""The changelog folded to state: replay, merge, and merge of two states.

Two folds exist on purpose.  Replay *replaces* what a key held; the live merge works
*per partition* and keeps the fresher scan.  Both ignore malformed records.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.operators.codec import decode, heartbeat_fields, instance_id_of, partition_rows, slice_of, topic_of
from quietlog.schema import PARTITION_FIELDS, STATE, STATE_COLUMNS
from quietlog.sources.tables import materialise

# A partition row without its topic.
ROW = T.StructType([f for f in STATE if f.name not in ("topic", "last_update")])


def arrival(moved_keys: bool = False) -> Column:
    """Order of the records of one key.

    A key stays in one changelog partition, so its offsets order it.  Where the number
    of changelog partitions was changed, pass ``moved_keys`` to order by time first.
    """
    if moved_keys:
        return F.struct("timestamp", "partition", "offset")
    return F.col("offset")


def _last_per_key(records: DataFrame, payload: str) -> DataFrame:
    """(key, payload) of the last valid record of every key, without the keys it deletes.

    ``records`` has key, seq (null on malformed records, which then lose without a
    filter that would parse the value once more) and ``payload``, null on tombstones.
    Partial aggregation keeps one record per key and task before the shuffle.
    """
    return records.groupBy("key").agg(
        F.max_by(payload, F.col("seq")).alias("payload"), F.max("seq").alias("seq")
    ).where(F.col("payload").isNotNull() & F.col("seq").isNotNull())


def replay_topics(changelog: DataFrame, load_time: int, moved_keys: bool = False) -> DataFrame:
    """State table of the last valid record of every topic.

    The raw value travels through the aggregation and only the surviving records are
    expanded to partitions.  Of the further records of wide topics those count that
    their head names.  ``last_update`` is the load time.
    """
    records = decode(changelog).where(F.col("instance_id").isNull()).select(
        "key", F.col("value").alias("payload"), F.when(F.col("is_valid"), arrival(moved_keys)).alias("seq"))
    last = decode(_last_per_key(records, "payload").select("key", F.col("payload").alias("value"))).select(
        topic_of(F.col("key")).alias("topic"), slice_of(F.col("key")).alias("number"), "topic_record")
    heads = last.where(F.col("number").isNull())
    named = heads.where(F.col("topic_record.slices") > 1).select(
        "topic", F.col("topic_record.slice_width").alias("width"), F.explode("topic_record.ranges").alias("number"))
    slices = last.where(F.col("number").isNotNull()).join(named, ["topic", "number"]).where(
        F.col("topic_record.slice_width") == F.col("width"))
    kept = heads.select("topic", "topic_record").unionByName(slices.select("topic", "topic_record"))
    expanded = kept.select("topic", F.explode_outer(partition_rows(F.col("topic_record"))).alias("row"))
    return expanded.select("topic", "row.*", F.lit(load_time).cast("bigint").alias("last_update")).select(*STATE_COLUMNS)


def replay_heartbeats(changelog: DataFrame, moved_keys: bool = False) -> DataFrame:
    """The last valid heartbeat of every instance without a later tombstone."""
    body = F.struct("instance_id", F.col("heartbeat").alias("body"))
    records = decode(changelog).where(F.col("instance_id").isNotNull()).select(
        "key", F.when(~F.col("is_tombstone"), body).alias("payload"), F.when(F.col("is_valid"), arrival(moved_keys)).alias("seq"))
    return _last_per_key(records, "payload").select(*heartbeat_fields(F.col("payload.body"), F.col("payload.instance_id")))


def last_tombstones(changelog: DataFrame, seq: Column) -> DataFrame:
    """(topic, cleared_at) of every topic that was ever deleted."""
    deleted = changelog.where(F.col("value").isNull() & instance_id_of(F.col("key")).isNull())
    return deleted.groupBy(topic_of(F.col("key")).alias("topic")).agg(F.max(seq).alias("cleared_at"))


def alive_rows(changelog: DataFrame, cleared: DataFrame, seq: Column) -> DataFrame:
    """Partition rows of the valid topic records that come after their last tombstone.

    ``cleared`` is (topic, cleared_at).  All slices of a wide topic lie in one changelog
    partition, so their offsets compare.  Each record also gives one marker row with a null
    partition, from which the last record of the topic follows.  Malformed records give
    no row; they are dropped after the expansion, so that no value is parsed twice.
    """
    pending = (
        changelog.where(F.col("value").isNotNull()).withColumn("topic", topic_of(F.col("key")))
        .join(cleared, "topic", "left")
        .where(F.col("cleared_at").isNull() | (seq > F.col("cleared_at")))
    )
    record = F.col("topic_record")
    rows = F.concat(
        F.array(F.struct(F.lit(True).alias("is_marker"), F.lit(None).cast(ROW).alias("row"))),
        F.transform(F.coalesce(partition_rows(record), F.array().cast(T.ArrayType(ROW))),
                    lambda r: F.struct(F.lit(False).alias("is_marker"), r.alias("row"))))
    return (
        decode(pending)
        .where(F.col("instance_id").isNull())
        .select("topic", seq.alias("seq"),
                F.struct(seq.alias("seq"), F.coalesce(record["timestamp"], F.lit(0)).alias("written_at")).alias("last_record"),
                F.explode_outer(F.when(F.col("is_valid"), rows)).alias("entry"))
        .where(F.col("entry").isNotNull())
        .select("topic", "entry.row", "seq", "last_record")
    )


def fold_alive(alive: DataFrame) -> DataFrame:
    """The fresher row of every (topic, partition): higher ``scanned_at``, then later."""
    return alive.groupBy("topic", F.col("row.partition").alias("partition")).agg(
        F.max_by(F.struct("row", "seq"), F.struct("row.scanned_at", "seq")).alias("best"),
        F.max("last_record").alias("last_record"),
    ).select("topic", "best.row", "best.seq", "last_record")


def folded_state(folded: DataFrame) -> DataFrame:
    """State table of folded rows; a marker has the write time of the topic's last record."""
    update = F.when(F.col("row.partition").isNull(), F.col("last_record.written_at"))
    return folded.select("topic", "row.*", update.alias("last_update")).select(*STATE_COLUMNS)


def merge_topics(changelog: DataFrame, moved_keys: bool = False) -> DataFrame:
    """State table of all records since the last tombstone, merged per partition."""
    seq = arrival(moved_keys)
    # Few topics are ever deleted; the frame is written out so that the join knows its size.
    cleared = materialise(last_tombstones(changelog, seq), "tombstones")
    return folded_state(fold_alive(alive_rows(changelog, cleared, seq)))


def merge_states(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Two versions of a state merged per partition.

    On conflict the higher ``scanned_at`` wins and a tie goes to the incoming row;
    ``last_update`` follows the incoming version where a topic has one.  Both sides
    hold unique keys, so the join spreads evenly.
    """
    def side(state: DataFrame, name: str) -> DataFrame:
        rows = state.where(F.col("partition").isNotNull())
        return rows.select("topic", "partition", F.struct(*PARTITION_FIELDS).alias(name))

    old, new = F.col("old"), F.col("new")
    take_new = old.isNull() | (
        new.isNotNull() & (F.coalesce(new["scanned_at"], F.lit(0)) >= F.coalesce(old["scanned_at"], F.lit(0))))
    partitions = (
        side(current, "old").join(side(incoming, "new"), ["topic", "partition"], "full_outer")
        .select("topic", "partition", F.when(take_new, new).otherwise(old).alias("row"))
        .select("topic", "partition", "row.*", F.lit(None).cast("bigint").alias("last_update"))
    )
    updates = current.select("topic", F.col("last_update").alias("old_update")).unionByName(
        incoming.select("topic", F.col("last_update").alias("new_update")), allowMissingColumns=True)
    markers = updates.groupBy("topic").agg(
        F.coalesce(F.max("new_update"), F.max("old_update")).alias("last_update"))
    return partitions.unionByName(markers, allowMissingColumns=True).select(*STATE_COLUMNS)
