"""Changelog records to and from rows.

A topic record carries a whole topic, and its key is the topic's name.  A topic with
partition numbers of ``SLICE_WIDTH`` or more is written as several records, one per range
of numbers, so that no task ever builds more than that many partitions into one value.  Each
has a key of its own, ``topic`` for the first range and ``topic#n`` for range n (no topic name
may hold the mark), so a compacted log keeps them all.  The first one is the head: it
names the width, the number of ranges and each further range that holds rows, and on replay
only the ranges that it names count.  A range gets rows only with a record of its own, so a
range that the head names was written since the topic was last replaced or deleted: a record
of the whole topic, from whatever writer, replaces all ranges for good, a topic that grows
again does not bring old ones back, and without a head there is no topic.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.schema import CORRUPT, HEARTBEAT_KEY_PREFIX, HEARTBEAT_RECORD, TOPIC_RECORD

SLICE_WIDTH = 5_000
_JSON_READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
_JSON_WRITE = {"ignoreNullFields": "true"}
_INTEGER = r"^[+-]?[0-9]+$"
_CLOSED_OBJECT = r"\}\s*$"
_SLICE_KEY = "#([0-9]{1,9})$"


def slice_of(key: Column) -> Column:
    """Number of the range that a slice key names, null for other keys."""
    return F.nullif(F.regexp_extract(key, _SLICE_KEY, 1), F.lit("")).cast("int")


def topic_of(key: Column) -> Column:
    """Topic of a topic key, with or without a slice."""
    return F.regexp_replace(key, _SLICE_KEY, "")


def instance_id_of(key: Column) -> Column:
    """Instance id of a heartbeat key, null for a topic key."""
    rest = F.substring(key, F.lit(len(HEARTBEAT_KEY_PREFIX) + 1), F.length(key))
    is_heartbeat = key.startswith(HEARTBEAT_KEY_PREFIX) & (F.btrim(rest, F.lit(" \t\r\n\v\f")) != "")
    return F.when(is_heartbeat, rest)


def _well_formed(value: Column, decoded: Column) -> Column:
    return decoded.isNotNull() & decoded[CORRUPT].isNull() & value.rlike(_CLOSED_OBJECT)


def decode(changelog: DataFrame) -> DataFrame:
    """Classify and parse every record once.

    Adds instance_id (null on topic records), is_tombstone, is_valid (false on
    malformed values, true on tombstones), topic_record and heartbeat.
    """
    key, value = F.col("key"), F.col("value")
    is_topic = F.col("instance_id").isNull()
    parsed = changelog.withColumn("instance_id", instance_id_of(key)).withColumns({
        "topic_record": F.when(is_topic, F.from_json(value, TOPIC_RECORD, _JSON_READ)),
        "heartbeat": F.when(~is_topic, F.from_json(value, HEARTBEAT_RECORD, _JSON_READ)),
    })
    topic, heartbeat = F.col("topic_record"), F.col("heartbeat")
    integer_keys = F.forall(
        F.map_keys(F.coalesce(topic["partitions"], F.create_map().cast(TOPIC_RECORD["partitions"].dataType))),
        lambda k: k.rlike(_INTEGER) & k.try_cast("int").isNotNull())
    valid_topic = _well_formed(value, topic) & integer_keys
    return parsed.withColumns({
        "is_tombstone": value.isNull(),
        "is_valid": value.isNull() | F.coalesce(F.when(is_topic, valid_topic).otherwise(_well_formed(value, heartbeat)),
                                                F.lit(False)),
    })


def partition_rows(record: Column) -> Column:
    """The partition map of a topic record as an array of rows.

    The map key is the partition number; absent fields read as 0 or false.  Should a
    number occur twice (``0`` and ``00``), the last one counts.
    """
    def row(entry: Column) -> Column:
        body = entry["value"]
        zero = F.lit(0).cast("bigint")
        return F.struct(
            entry["key"].try_cast("int").alias("partition"),
            F.coalesce(body["offset"], zero).alias("offset"),
            F.coalesce(body["timestamp"], zero).alias("timestamp"),
            F.coalesce(body["is_empty"], F.lit(False)).alias("is_empty"),
            F.coalesce(body["scanned_at"], zero).alias("scanned_at"),
            F.coalesce(body["message_count"], zero).alias("message_count"),
        )
    rows = F.transform(F.map_entries(record["partitions"]), row)
    numbers = F.transform(F.map_keys(record["partitions"]), lambda k: k.try_cast("int"))
    repeated = F.size(F.array_distinct(numbers)) < F.size(numbers)

    def is_last(entry: Column, i: Column) -> Column:
        later = F.slice(rows, i + 2, F.greatest(F.size(rows) - i - 1, F.lit(0)))
        return ~F.exists(later, lambda other: other["partition"] == entry["partition"])
    return F.when(repeated, F.filter(rows, is_last)).otherwise(rows)


def heartbeat_fields(heartbeat: Column, instance_id: Column) -> list[Column]:
    """Heartbeat columns with absent fields as 0 or empty; the key names the instance."""
    def number(name: str, kind: str) -> Column:
        return F.coalesce(heartbeat[name], F.lit(0)).cast(kind).alias(name)
    return [
        instance_id.alias("instance_id"),
        number("last_heartbeat_at", "bigint"),
        number("heartbeat_interval_sec", "int"),
        number("scan_interval_sec", "int"),
        F.coalesce(heartbeat["group_id"], F.lit("")).alias("group_id"),
        number("assigned_shards", "int"),
    ]


def encode_topics(state: DataFrame, write_time, observed_only: bool = False,
                  slice_width: int = SLICE_WIDTH, versions: Sequence[str] = ()) -> DataFrame:
    """(key, value, slice) topic records of a state table (K1).

    With ``observed_only`` a record is written only where a row of its slice has
    ``observed`` set; the others are unchanged in the log.  The head of a wide topic is
    written with any of its slices.  Write everything when ``slice_width`` changes.
    ``versions`` names further columns, such as a scan number, each value of which has
    records of its own.
    """
    body = F.struct(
        F.col("partition"),
        F.col("offset"),
        F.col("timestamp"),
        F.col("is_empty"),
        F.nullif(F.col("scanned_at"), F.lit(0)).alias("scanned_at"),
        F.nullif(F.col("message_count"), F.lit(0)).alias("message_count"),
    )
    further = F.when(~F.col("target.own"), F.col("target.slices") - 1)
    entry = F.when(F.col("target.own") & F.col("partition").isNotNull(),
                   F.struct(F.col("partition").cast("string").alias("key"), body.alias("value")))
    number = F.coalesce(F.floor(F.col("partition") / F.lit(slice_width)).cast("int"), F.lit(0))

    def target(slice_no: Column, own: bool) -> Column:
        return F.struct(slice_no.alias("slice"), F.lit(own).alias("own"), (number + 1).alias("slices"))
    # A row beyond the first range is also counted at the head, which so learns which ranges hold rows.
    targets = F.when(number > 0, F.array(target(number, True), target(F.lit(0), False))).otherwise(
        F.array(target(F.lit(0), True)))
    observed = F.bool_or("observed") if observed_only else F.lit(True)
    when = write_time if isinstance(write_time, Column) else F.lit(write_time).cast("bigint")
    is_head = F.col("slice") == 0
    is_wide = F.col("slices") > 1
    return (
        state.withColumn("target", F.explode(targets))
        .groupBy("topic", F.col("target.slice").alias("slice"), *versions)
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"), observed.alias("observed"),
             F.max("target.slices").alias("slices"), F.sort_array(F.collect_set(further)).alias("ranges"))
        .where("observed")
        .select(
            F.when(is_head, F.col("topic")).otherwise(F.concat("topic", F.lit("#"), "slice")).alias("key"),
            F.to_json(F.struct(
                F.lit(1).alias("version"),
                F.col("topic"),
                when.alias("timestamp"),
                F.map_from_entries("entries").alias("partitions"),
                F.nullif(F.col("slice"), F.lit(0)).alias("slice"),
                F.when(is_head & is_wide, F.col("slices")).alias("slices"),
                F.when(is_wide, F.lit(slice_width)).alias("slice_width"),
                F.when(is_head & is_wide, F.col("ranges")).alias("ranges"),
            ), _JSON_WRITE).alias("value"),
            "slice",
            *versions,
        )
    )


def encode_topic(state: DataFrame, topic: str, write_time) -> DataFrame:
    """Records of one topic only (K2)."""
    return encode_topics(state.where(F.col("topic") == topic), write_time)


def topic_tombstones(topics: DataFrame, state: DataFrame | None = None,
                     slice_width: int = SLICE_WIDTH, versions: Sequence[str] = ()) -> DataFrame:
    """(key, value) tombstones of a ``topic`` column (K3).

    ``state`` is the last state of the topics; the slices of the wide ones among them
    get tombstones too.  ``versions`` names further columns of ``topics`` that come along.
    """
    keys = topics.select(F.col("topic").alias("key"), *versions)
    if state is not None:
        number = F.floor(F.col("partition") / F.lit(slice_width)).cast("string")
        wide = state.where(F.col("partition") >= slice_width).select("topic", F.concat("topic", F.lit("#"), number).alias("key"))
        keys = keys.union(wide.distinct().join(topics.select("topic", *versions), "topic").select("key", *versions))
    return keys.withColumn("value", F.lit(None).cast("string"))


def encode_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """(key, value) heartbeat records (K4)."""
    return heartbeats.select(
        F.concat(F.lit(HEARTBEAT_KEY_PREFIX), F.col("instance_id")).alias("key"),
        F.to_json(F.struct(
            F.lit(1).alias("version"),
            F.col("instance_id"),
            F.col("last_heartbeat_at"),
            F.col("heartbeat_interval_sec"),
            F.nullif(F.col("scan_interval_sec"), F.lit(0)).alias("scan_interval_sec"),
            F.nullif(F.col("group_id"), F.lit("")).alias("group_id"),
            F.nullif(F.col("assigned_shards"), F.lit(0)).alias("assigned_shards"),
        ), _JSON_WRITE).alias("value"),
    )


def instance_tombstones(instances: DataFrame) -> DataFrame:
    """(key, value) tombstones of an ``instance_id`` column (K5)."""
    return instances.select(
        F.concat(F.lit(HEARTBEAT_KEY_PREFIX), F.col("instance_id")).alias("key"),
        F.lit(None).cast("string").alias("value"))
