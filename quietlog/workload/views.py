"""Offset histories, states, logs and configurations derived from the driver tables.

The definitions are in ``FIXTURES.md`` part B.  All of them are computed over whole
tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietlog.functions.ages import epoch_seconds
from quietlog.functions.names import is_system_topic
from quietlog.functions.sharding import shard
from quietlog.operators.codec import encode_heartbeats, encode_topics
from quietlog.operators.history import last_change_history, returns_of, topic_epochs
from quietlog.schema import DEFAULT_SHARDS
from quietlog.sources.tables import materialise

BASE = 1704067200
DAY = 86400
SCANS = 30
AS_OF = 1706659200
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
# Distance between the changelog offsets of two scans.
OFFSETS_PER_SCAN = 10**12


def scan_time(n) -> Column:
    return F.lit(BASE) + n.cast("bigint") * F.lit(DAY)


def scan_no(time: Column) -> Column:
    return F.call_function("div", time - F.lit(BASE), F.lit(DAY).cast("bigint")).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a partitioned record log: a topic per event type and user."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.when(user % 29 == 0, F.lit("_")).otherwise(F.lit("")), F.col("event_type"),
                 F.lit(".user-"), user.cast("string")).alias("topic"),
        (F.col("event_id") % 2).cast("int").alias("partition"),
        F.call_function("div", F.col("event_id"), F.lit(2).cast("bigint")).alias("offset"),
        epoch_seconds(F.col("ts")).alias("ts"),
        "user_id",
        "event_type",
    )


def _day_of(ts: Column) -> Column:
    days = F.call_function("div", ts - F.lit(BASE) + F.lit(DAY - 1), F.lit(DAY).cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), days).cast("int")


def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = record_log(spark, sf_dir)
    return log.groupBy("topic", "partition", "user_id", _day_of(F.col("ts")).alias("n")).agg(
        F.count(F.lit(1)).alias("records"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (topic, partition) at every scan from the first record of the topic on."""
    topics = record_log(spark, sf_dir).groupBy("topic", "user_id").agg(
        F.min("ts").alias("first_ts"),
        F.bool_or(F.col("partition") == 0).alias("has_0"), F.bool_or(F.col("partition") == 1).alias("has_1"))
    partitions = F.array_compact(F.array(F.when(F.col("has_0"), F.lit(0)), F.when(F.col("has_1"), F.lit(1))))
    return (
        topics.select("topic", "user_id", "first_ts", F.explode(partitions).alias("partition"))
        .select("topic", "user_id", "partition",
                F.explode(F.when(_day_of(F.col("first_ts")) <= SCANS, F.sequence(_day_of(F.col("first_ts")), F.lit(SCANS)))).alias("n"))
    )


def _is_listed() -> Column:
    away = (F.col("user_id") % 41 == 0) & F.col("n").between(20, 22)
    return ~is_system_topic(F.col("topic")) & ~away


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with system topics still in it."""
    away = (F.col("user_id") % 41 == 0) & F.col("n").between(20, 22)
    return _grid(spark, sf_dir).where(~away).select("topic", "partition", scan_time(F.col("n")).alias("scan_time"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).where(_is_listed()).select(
        "topic", "partition", scan_time(F.col("n")).alias("scan_time"))


def scan_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed partitions at every scan with their watermarks, after 7 days of retention.

    Record counts per day are added up over range frames, so each window holds a
    partition's days and never its records.  ``asked`` is false where an answer is missing.
    """
    counts = _daily_counts(spark, sf_dir).withColumn("listed", F.lit(False))
    grid = _grid(spark, sf_dir).withColumn("records", F.lit(0).cast("bigint")).withColumn("listed", F.lit(True))
    by_day = Window.partitionBy("topic", "partition").orderBy("n")
    user, n, part = F.col("user_id"), F.col("n"), F.col("partition")
    cumulated = grid.unionByName(counts).select(
        "topic", "partition", "user_id", "n", "listed",
        F.sum("records").over(by_day.rangeBetween(Window.unboundedPreceding, 0)).alias("latest0"),
        F.coalesce(F.sum("records").over(by_day.rangeBetween(Window.unboundedPreceding, -7)), F.lit(0)).alias("earliest0"),
    )
    asked = (user + 2 * n + part) % 53 != 0
    latest = F.when((user + n) % 37 == 0, F.greatest(F.col("latest0") - 1, F.lit(0).cast("bigint"))).otherwise(F.col("latest0"))
    return cumulated.where(F.col("listed") & _is_listed()).select(
        "topic", "partition", scan_time(n).alias("scan_time"), asked.alias("asked"),
        F.when(asked, latest).alias("latest"),
        F.when(asked & ((user + n) % 31 != 0), F.col("earliest0")).alias("earliest"),
    )


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_frame(spark, sf_dir).where("asked").drop("asked")


def scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(listing, observation) as tables, the way a scanner leaves them."""
    table_of_scans = materialise(scan_frame(spark, sf_dir), "scans")
    return (table_of_scans.select("topic", "partition", "scan_time"),
            table_of_scans.where("asked").drop("asked"))


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a state table: a topic per customer, two partitions each."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 2).cast("int").alias("partition"))
        .agg(F.count(F.lit(1)).alias("offset"), F.max(epoch_seconds(F.col("o_orderdate"))).alias("timestamp"))
        .select(
            F.concat(F.lit("orders.cust-"), F.col("customer").cast("string")).alias("topic"),
            "partition", "offset", "timestamp", F.lit(False).alias("is_empty"),
            F.col("timestamp").alias("scanned_at"), F.col("offset").alias("message_count"),
            F.col("timestamp").alias("last_update"))
    )


def wide_order_state(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    """``orders`` as one very wide topic: a partition per order."""
    when = epoch_seconds(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        F.lit(topic).alias("topic"), F.col("o_orderkey").cast("int").alias("partition"),
        F.col("o_custkey").cast("bigint").alias("offset"), when.alias("timestamp"), F.lit(False).alias("is_empty"),
        when.alias("scanned_at"), F.col("o_custkey").cast("bigint").alias("message_count"), when.alias("last_update"))


def single_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as one topic per order."""
    rows = wide_order_state(spark, sf_dir, "")
    return rows.withColumn("topic", F.concat(F.lit("order-"), F.col("partition").cast("string"))).withColumn("partition", F.lit(0))


def order_as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The latest order time as a scalar subquery."""
    return table(spark, sf_dir, "orders").agg(F.max(epoch_seconds(F.col("o_orderdate")))).scalar()


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heartbeat per user of ``events``."""
    user = F.col("user_id")
    return (
        table(spark, sf_dir, "events").groupBy("user_id")
        .agg(F.max(epoch_seconds(F.col("ts"))).alias("last_heartbeat_at"),
             F.max_by("event_type", F.struct("ts", "event_id")).alias("group_id"))
        .select(
            F.concat(F.lit("user-"), user.cast("string")).alias("instance_id"),
            "last_heartbeat_at",
            (F.lit(1800) * (user % 4)).cast("int").alias("heartbeat_interval_sec"),
            F.lit(0).alias("scan_interval_sec"),
            "group_id",
            (user % 7).cast("int").alias("assigned_shards"))
    )


def topic_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three configuration values per customer, some of them null."""
    key = F.col("c_custkey")
    policy = (F.when(key % 5 == 0, F.lit("compact")).when(key % 5 == 1, F.lit("compact,delete"))
              .when(key % 5 == 2, F.lit(" delete, COMPACT ")).when(key % 5 == 3, F.lit("delete")))
    segment = F.when(key % 3 == 0, F.lit("86400000")).when(key % 3 == 1, F.lit("2048"))
    ratio = F.when(key % 2 == 0, F.lit("0.1")).otherwise(F.lit("0.5"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cfg-"), key.cast("string")).alias("topic"),
        F.explode(F.array(
            F.struct(F.lit("cleanup.policy").alias("name"), policy.alias("value")),
            F.struct(F.lit("segment.ms").alias("name"), segment.alias("value")),
            F.struct(F.lit("min.cleanable.dirty.ratio").alias("name"), ratio.alias("value")),
        )).alias("entry"),
    ).select("topic", "entry.*")


def state_per_scan(observations: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, tombstones) of everything the scans wrote, with ``n`` the scan number.

    Each answered row is valid until the next answer for its partition; it is repeated
    for the scans in between at which its topic was processed.
    """
    epochs = materialise(topic_epochs(listings).withColumn("n", scan_no(F.col("scan_time"))), "epochs")
    by_scan = Window.partitionBy("topic", "partition", "epoch").orderBy("n")
    # Both are read several times below.
    history = materialise(
        last_change_history(observations, returns_of(epochs)).withColumn("n", scan_no(F.col("scan_time"))), "history")
    until = F.coalesce(F.lead("n").over(by_scan) - 1, F.lit(SCANS))
    filled = (
        history.withColumn("until", until)
        .withColumn("scanned_at", F.col("scan_time"))
        .withColumn("n", F.explode(F.sequence("n", "until")))
    )
    processed = history.select("topic", "epoch", "n").distinct()
    rows = filled.join(processed, ["topic", "epoch", "n"], "left_semi").select(
        "topic", "n", "partition", "offset", "timestamp", "is_empty", "scanned_at", "message_count",
        scan_time(F.col("n")).alias("last_update"))
    # A topic that was processed in an epoch is deleted at the scan after its last listing.
    ends = epochs.groupBy("topic", "epoch").agg((F.max("n") + 1).alias("n")).where(F.col("n") <= SCANS)
    tombstones = ends.join(processed.select("topic", "epoch").distinct(), ["topic", "epoch"], "left_semi").select(
        "topic", "n")
    return rows, tombstones


def _topic_index(topic: Column) -> Column:
    kinds = F.array(*[F.lit(kind) for kind in EVENT_TYPES])
    user = F.substring_index(topic, "-", -1).cast("bigint")
    return user * 8 + F.array_position(kinds, F.substring_index(topic, ".", 1))


def changelog(spark: SparkSession, sf_dir: str, partial_writers: bool = False) -> DataFrame:
    """The log that 30 scans leave behind, with every 97th value broken.

    With ``partial_writers`` the record of scan n has only the partitions of its parity.
    """
    listings, observations = scans(spark, sf_dir)
    rows, tombstones = state_per_scan(observations, listings)
    if partial_writers:
        mine = F.col("partition") % 2 == F.col("n") % 2
        rows = rows.withColumn("partition", F.when(mine, F.col("partition")))
    n = F.col("n")
    written = encode_topics(rows, scan_time(n), versions=["n"]).select("key", "value", "n")
    removed = tombstones.select(F.col("topic").alias("key"), F.lit(None).cast("string").alias("value"), "n")
    offset = n.cast("bigint") * OFFSETS_PER_SCAN + _topic_index(F.col("key"))
    broken = F.col("value").isNotNull() & (offset % 97 == 0)
    return written.unionByName(removed).select(
        "key",
        F.when(broken, F.lit("{not-json")).otherwise(F.col("value")).alias("value"),
        shard(F.col("key"), F.lit(0), DEFAULT_SHARDS).alias("partition"),
        offset.alias("offset"),
        F.timestamp_seconds(scan_time(n)).alias("timestamp"),
    )


def heartbeat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_heartbeats(heartbeats(spark, sf_dir))
