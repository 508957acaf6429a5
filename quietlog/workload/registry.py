"""Registered queries: one per operator or report, each over whole driver tables."""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.arguments import Page, Thresholds
from quietlog.functions.ages import age_parts, age_seconds, age_text, epoch_seconds
from quietlog.functions.names import name_matcher, search_predicate
from quietlog.operators import audit, codec, history, instances, ordering, ownership, profile, ranking, replay, rollup, scan, validity
from quietlog.plans import reports, scan_cycle
from quietlog.schema import STATE_COLUMNS
from quietlog.session import prepare, scratch_dir
from quietlog.sources import changelog as log_source
from quietlog.sources import configs, watermarks
from quietlog.sources.tables import materialise
from quietlog.streaming import live, scans, tail
from quietlog.workload import views
from quietlog.workload.views import AS_OF, BASE, DAY

Query = Callable[[SparkSession, str], DataFrame]
_STALE, _UNUSED = 3, 4
_O_STALE, _O_UNUSED = 180, 365
_RETAINED_FROM = AS_OF - 7 * DAY
_WITHOUT_UPDATE = [name for name in STATE_COLUMNS if name != "last_update"]


def _at(n: int) -> int:
    return BASE + n * DAY


def _log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the record log itself: the last record time of each partition."""
    log = views.record_log(spark, sf_dir)
    return watermarks.topic_listing(log).groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("offset"), F.max("ts").alias("timestamp"),
    ).withColumns({"is_empty": F.lit(False), "scanned_at": F.col("timestamp"),
                   "message_count": F.col("offset"), "last_update": F.col("timestamp")})


def _state(spark: SparkSession, sf_dir: str, n: int = 30) -> DataFrame:
    listing, observation = views.scans(spark, sf_dir)
    return history.state_as_of(observation, listing, _at(n))


def _at_scan(frame: DataFrame, n: int) -> DataFrame:
    return frame.where(F.col("scan_time") == _at(n))


def _rows(state: DataFrame) -> DataFrame:
    return rollup.partitions_of(state).select(*_WITHOUT_UPDATE)


# -- log and watermarks -------------------------------------------------------------------

def unused_topics_from_log(spark, sf_dir):
    return reports.list_report(_log_state(spark, sf_dir), AS_OF, stale_days=_STALE, unused_days=_UNUSED)


def topic_listing(spark, sf_dir):
    return watermarks.topic_listing(views.raw_listing(spark, sf_dir))


def listed_partition_counts(spark, sf_dir):
    return watermarks.listed_partition_counts(_at_scan(views.raw_listing(spark, sf_dir), 30))


def scan_latest_offsets(spark, sf_dir):
    return watermarks.latest_from_log(views.record_log(spark, sf_dir))


def scan_earliest_offsets(spark, sf_dir):
    return watermarks.earliest_from_log(views.record_log(spark, sf_dir))


def scan_watermarks(spark, sf_dir):
    return watermarks.watermarks_from_log(views.record_log(spark, sf_dir), F.col("ts") > _RETAINED_FROM)


def offset_answers(spark, sf_dir):
    log = views.record_log(spark, sf_dir)
    answers = log.groupBy("topic", "partition", "user_id").agg((F.max("offset") + 1).alias("offset")).withColumn(
        "error_code", F.when(F.col("user_id") % 11 == 0, F.lit(5)).otherwise(F.lit(0)))
    return watermarks.latest_offsets(answers)


def observation_join(spark, sf_dir):
    log = views.record_log(spark, sf_dir)
    kept = log.where(F.col("ts") > _RETAINED_FROM)
    return scan.partition_counts(scan.join_watermarks(
        watermarks.latest_from_log(log), watermarks.earliest_from_log(kept)))


# -- scans over time ----------------------------------------------------------------------

def last_change_backfill(spark, sf_dir):
    listing, observation = views.scans(spark, sf_dir)
    return history.last_change_history(observation, history.topic_returns(listing))


def topic_epochs(spark, sf_dir):
    return history.topic_epochs(views.listing(spark, sf_dir)).groupBy("topic", "epoch").agg(
        F.min("scan_time").alias("first_scan"), F.max("scan_time").alias("last_scan"), F.count(F.lit(1)).alias("scans"))


def state_as_of_scan(spark, sf_dir):
    return _rows(_state(spark, sf_dir))


def state_as_of_scan_with_deletions(spark, sf_dir):
    return _rows(_state(spark, sf_dir, 21))


def _fold(spark, sf_dir, n):
    listing, observation = views.scans(spark, sf_dir)
    previous = materialise(history.state_as_of(observation, listing, _at(n - 1)), "state")
    return previous, _at_scan(listing, n), _at_scan(observation, n)


def last_change_incremental(spark, sf_dir):
    previous, listing, observation = _fold(spark, sf_dir, 23)
    return _rows(scan.fold_scan(previous, listing, observation, _at(23)).state)


def deleted_topics(spark, sf_dir):
    previous, listing, _ = _fold(spark, sf_dir, 20)
    return scan.deleted_topics(previous, listing)


def scan_counters(spark, sf_dir):
    listing, observation = views.scans(spark, sf_dir)
    listed = _at_scan(listing, 30)
    return scan.scan_counters(listed, listed, _at_scan(observation, 30))


def scan_cycle_records(spark, sf_dir):
    """Decoded content of what the scan at n = 20 appends to the log."""
    previous, listing, observation = _fold(spark, sf_dir, 20)
    outcome = scan_cycle.scan_state(previous, listing, observation, _at(20))
    decoded = codec.decode(outcome.records)
    rows = decoded.select("key", "is_tombstone", F.explode_outer(codec.partition_rows(F.col("topic_record"))).alias("row"))
    return rows.groupBy("key", F.col("is_tombstone").alias("tombstone")).agg(
        F.count("row").alias("partitions"),
        F.coalesce(F.sum("row.offset"), F.lit(0)).alias("offsets"),
        F.coalesce(F.sum("row.timestamp"), F.lit(0)).alias("timestamps"))


# -- roll-ups and status --------------------------------------------------------------------

def topic_rollup(spark, sf_dir):
    return rollup.topic_rollup(_state(spark, sf_dir))


def topic_status(spark, sf_dir):
    return reports.status_report(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), _O_STALE, _O_UNUSED
                                 ).select("name", "status", "newest_days", "oldest_days")


def stale_partitions(spark, sf_dir):
    return reports.stale_partitions(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), _O_STALE)


def stale_by_topic(spark, sf_dir):
    return rollup.topic_rollup(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), _O_STALE
                               ).select("name", "stale_partitions")


def _order_ages(spark, sf_dir):
    elapsed = age_seconds(epoch_seconds(F.col("o_orderdate")), views.order_as_of(spark, sf_dir))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", (elapsed + F.col("o_orderkey") % 100000).alias("elapsed"))


def age_parts_of_orders(spark, sf_dir):
    return _order_ages(spark, sf_dir).select("o_orderkey", age_parts(F.col("elapsed")).alias("age")).select(
        "o_orderkey", "age.*")


def age_text_of_orders(spark, sf_dir):
    return _order_ages(spark, sf_dir).select("o_orderkey", age_text(F.col("elapsed")).alias("age"))


# -- reports --------------------------------------------------------------------------------

def _list_orders(**options) -> Query:
    def query(spark, sf_dir):
        return reports.list_topics(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir),
                                   stale_days=_O_STALE, unused_days=_O_UNUSED, **options).rows
    return query


def list_topics_deep_page(spark, sf_dir):
    """A page behind position 10,000 of all orders as topics."""
    return reports.list_topics(views.single_order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), sort_by="messages",
                               page=21, limit=500, stale_days=_O_STALE, unused_days=_O_UNUSED).rows.select(
        "name", "position", "total_message_count")


def list_topics_indexed_pages(spark, sf_dir):
    """Pages 1, 21 and 30 of all orders as topics from one rank index."""
    path = scratch_dir(spark, "rank-index")
    topics = rollup.topic_rollup(views.single_order_state(spark, sf_dir))
    order = ordering.topic_order(F.lit(AS_OF), Thresholds.of(_O_STALE, _O_UNUSED), "messages")
    ranking.build_rank_index(topics, order, path, rows_per_range=2000)
    pages = [ranking.indexed_page(spark, path, order, Page.of(n, 500)).withColumn("page", F.lit(n)) for n in (1, 21, 30)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).select("page", "name", "position", "total_message_count")


def list_topics_by_empty(spark, sf_dir):
    return reports.list_topics(_state(spark, sf_dir), AS_OF, sort_by="empty", sort_dir="desc", limit=500,
                               stale_days=_STALE, unused_days=_UNUSED).rows


def unused_topics(spark, sf_dir):
    return reports.unused_topics(_state(spark, sf_dir), AS_OF, sort_by="age", sort_dir="desc", page=2,
                                 stale_days=_STALE, unused_days=_UNUSED).rows


def empty_topics(spark, sf_dir):
    return reports.empty_topics(_state(spark, sf_dir), AS_OF, stale_days=_STALE, unused_days=_UNUSED).rows


def page_meta(spark, sf_dir):
    return reports.unused_topics(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), page=2,
                                 stale_days=_O_STALE, unused_days=_O_UNUSED).meta


def topic_detail(spark, sf_dir):
    return reports.topic_detail(views.order_state(spark, sf_dir), "orders.cust-7")


def topic_header(spark, sf_dir):
    return reports.topic_header(views.order_state(spark, sf_dir), "orders.cust-7")


def cluster_stats(spark, sf_dir):
    alive = instances.with_liveness(views.heartbeats(spark, sf_dir), AS_OF)
    return reports.cluster_stats(_state(spark, sf_dir), AS_OF, alive, stale_days=_STALE, unused_days=_UNUSED,
                                 local_instance_id="driver")


def list_report(spark, sf_dir):
    return reports.list_report(_state(spark, sf_dir), AS_OF, stale_days=_STALE, unused_days=_UNUSED)


def list_report_empty(spark, sf_dir):
    return reports.list_report(_state(spark, sf_dir), AS_OF, prefix="view", empty_only=True,
                               stale_days=_STALE, unused_days=_UNUSED)


def list_documents(spark, sf_dir):
    # Both halves of the report read the same state, so it is computed once.
    state = materialise(_state(spark, sf_dir), "state")
    report = reports.list_report(state, AS_OF, stale_days=_STALE, unused_days=_UNUSED)
    return reports.list_documents(report, state, AS_OF, _STALE)


def _wide_state(spark, sf_dir, topic: str) -> DataFrame:
    """Written, so that the one topic's name is a column and no constant."""
    return materialise(views.wide_order_state(spark, sf_dir, topic), "wide-state")


def list_documents_wide(spark, sf_dir):
    """All orders as one wide topic: what each line of its document holds."""
    state = _wide_state(spark, sf_dir, "orders.all").withColumn("timestamp", F.lit(AS_OF - 400 * DAY).cast("bigint"))
    lines = reports.list_documents(reports.list_report(state, AS_OF), state, AS_OF)
    details = "struct<slice:bigint,slices:bigint,stale_partition_details:array<struct<partition:int>>>"
    line = F.from_json("document", details)
    first = line["stale_partition_details"][0]["partition"]
    return lines.select("name", F.call_function("div", first, F.lit(5000)).cast("bigint").alias("range"),
                        F.size(line["stale_partition_details"]).cast("bigint").alias("partitions"), line["slices"].alias("slices"))


def _order_report(spark, sf_dir):
    return reports.list_report(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir),
                               stale_days=_O_STALE, unused_days=_O_UNUSED)


def list_header(spark, sf_dir):
    return reports.list_header(_order_report(spark, sf_dir), AS_OF)


def list_sub_rows(spark, sf_dir):
    return reports.list_sub_rows(_order_report(spark, sf_dir), views.order_state(spark, sf_dir),
                                 views.order_as_of(spark, sf_dir), _O_STALE)


def topic_documents(spark, sf_dir):
    return reports.topic_documents(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), search="-1")


def scan_summary(spark, sf_dir):
    return reports.scan_summary(views.order_state(spark, sf_dir), views.order_as_of(spark, sf_dir), search="CUST-1",
                                stale_days=_O_STALE, unused_days=_O_UNUSED)


def _matched(predicate: Callable[[], object]) -> Query:
    def query(spark, sf_dir):
        return views.order_state(spark, sf_dir).select(F.col("topic").alias("name")).distinct().where(predicate())
    return query


# -- changelog ------------------------------------------------------------------------------

def changelog_records(spark, sf_dir):
    return codec.encode_topics(views.order_state(spark, sf_dir), AS_OF).select("key", "value")


def changelog_encode_replay(spark, sf_dir):
    return replay.replay_topics(views.changelog(spark, sf_dir), AS_OF)


def _partial_log(spark, sf_dir):
    return materialise(views.changelog(spark, sf_dir, partial_writers=True), "changelog")


def changelog_merge(spark, sf_dir):
    return _rows(replay.merge_topics(_partial_log(spark, sf_dir)))


def changelog_merge_topics(spark, sf_dir):
    """Topics of the merged log, also those without partitions, with their last update."""
    return rollup.topic_rollup(replay.merge_topics(_partial_log(spark, sf_dir))).select(
        "name", "partition_count", "total_message_count", "last_update")


def changelog_one_topic(spark, sf_dir):
    return codec.encode_topic(views.order_state(spark, sf_dir), "orders.cust-7", AS_OF).select("key", "value")


def _placed(records: DataFrame, order: int) -> DataFrame:
    """Records of one writer in the log, later than those of a lower order."""
    offset = F.lit(order * 10**9) + F.coalesce(codec.slice_of(F.col("key")), F.lit(0))
    return records.select("key", "value", F.lit(0).alias("partition"), offset.cast("bigint").alias("offset"),
                          F.timestamp_seconds(F.lit(AS_OF)).alias("timestamp"))


def _compacted(log: DataFrame) -> DataFrame:
    """What a compacted log keeps: the last record of every key."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "partition", "offset", "timestamp"), "offset").alias("last"))
    return last.select("key", "last.*")


def changelog_wide_compacted(spark, sf_dir):
    """All orders as one wide topic, written twice, compacted and replayed."""
    state = _wide_state(spark, sf_dir, "orders.all")
    older = codec.encode_topics(state.withColumn("offset", F.col("offset") + 1), AS_OF)
    log = _placed(older, 0).unionByName(_placed(codec.encode_topics(state, AS_OF), 1))
    return _rows(replay.replay_topics(_compacted(log), AS_OF))


def changelog_wide_replaced(spark, sf_dir):
    """Two wide topics; another writer replaces one by a record of the whole topic, the other one is deleted."""
    first, second = (_wide_state(spark, sf_dir, f"orders.{name}") for name in "ab")
    whole = views.table(spark, sf_dir, "nation").select(
        F.lit("orders.a").alias("topic"), F.col("n_nationkey").cast("int").alias("partition"),
        F.col("n_regionkey").cast("bigint").alias("offset"), F.lit(AS_OF).cast("bigint").alias("timestamp"),
        F.lit(False).alias("is_empty"), F.lit(AS_OF).cast("bigint").alias("scanned_at"),
        F.col("n_regionkey").cast("bigint").alias("message_count"), F.lit(AS_OF).cast("bigint").alias("last_update"))
    gone = codec.topic_tombstones(second.select("topic").distinct(), second)
    log = (_placed(codec.encode_topics(first.unionByName(second), AS_OF), 0)
           .unionByName(_placed(codec.encode_topics(whole, AS_OF, slice_width=10**6), 1)).unionByName(_placed(gone, 2)))
    return _rows(replay.replay_topics(_compacted(log), AS_OF))


def changelog_wide_regrown(spark, sf_dir):
    """All orders as one wide topic; a record of the whole topic replaces it, then it grows wide again without most of its ranges."""
    state = _wide_state(spark, sf_dir, "orders.all")
    narrow = state.where(F.col("partition") % 1000 == 1)
    again = state.where((F.col("partition") < 100) | (F.col("partition") % 15000 < 7))
    log = (_placed(codec.encode_topics(state, AS_OF), 0)
           .unionByName(_placed(codec.encode_topics(narrow, AS_OF, slice_width=10**9), 1))
           .unionByName(_placed(codec.encode_topics(again, AS_OF), 2)))
    return _rows(replay.replay_topics(_compacted(log), AS_OF)).withColumn("log", F.lit("compacted")).unionByName(
        _rows(replay.replay_topics(log, AS_OF)).withColumn("log", F.lit("whole")))


def state_merge(spark, sf_dir):
    """The states of two writers, each of which was last seen at another scan; every row takes part."""
    listing, observation = views.scans(spark, sf_dir)
    current = history.state_as_of(observation, listing, _at(30))
    incoming = history.state_as_of(observation, listing, _at(26))
    return _rows(replay.merge_states(current, incoming))


def changelog_profile(spark, sf_dir):
    beats = views.heartbeat_records(spark, sf_dir).select(
        "key", "value", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
        F.timestamp_seconds(F.lit(AS_OF)).alias("timestamp"))
    return profile.changelog_profile(views.changelog(spark, sf_dir).unionByName(beats))


def changelog_profile_merged(spark, sf_dir):
    """Profiles of ten parts of the log, stored and added up; the estimated keys are within 3 % of the exact ones."""
    log, path = views.changelog(spark, sf_dir), scratch_dir(spark, "profiles")
    log = materialise(log, "changelog")
    n = ((F.unix_timestamp("timestamp") - F.lit(BASE)) / DAY).cast("int")
    for first in range(1, 31, 3):
        profile.batch_profile(log.where(n.between(first, first + 2))).write.mode("append").parquet(path)
    merged = profile.merged_profile(spark.read.parquet(path))
    exact = log.agg(F.count_distinct("key").alias("keys")).scalar()
    close = F.abs(F.col("unique_keys") - exact) <= 0.03 * exact
    return merged.withColumn("keys_are_close", close).drop("unique_keys")


def state_from_intervals(spark, sf_dir):
    """States as of scans 10, 20 and 30 from stored validity intervals."""
    listing, observation = views.scans(spark, sf_dir)
    path, period = scratch_dir(spark, "intervals"), 5 * DAY
    validity.write_intervals(validity.validity_intervals(observation, listing), path, period, _at(30))
    states = [validity.read_as_of(spark, path, _at(n), period).withColumn("n", F.lit(n)) for n in (10, 20, 30)]
    return states[0].unionByName(states[1]).unionByName(states[2])


def partitions_with_data(spark, sf_dir):
    return profile.partitions_with_data(views.changelog(spark, sf_dir))


def resume_offsets(spark, sf_dir):
    return profile.resume_offsets(views.changelog(spark, sf_dir), 8)


# -- instances, shards, configuration ---------------------------------------------------------

def _beat_log(spark, sf_dir):
    return log_source.normalise(views.heartbeat_records(spark, sf_dir).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        F.lit(0).alias("partition"), F.lit(0).alias("offset"), F.timestamp_seconds(F.lit(AS_OF)).alias("timestamp")))


def heartbeat_liveness(spark, sf_dir):
    return reports.instances(replay.replay_heartbeats(_beat_log(spark, sf_dir)), AS_OF)


def instance_prune(spark, sf_dir):
    expired = instances.expired_instances(replay.replay_heartbeats(_beat_log(spark, sf_dir)), AS_OF)
    return codec.instance_tombstones(expired).select("key", F.col("value").isNull().alias("is_tombstone"))


def live_instances(spark, sf_dir):
    return instances.live_instances(replay.replay_heartbeats(_beat_log(spark, sf_dir)), AS_OF).select(
        "instance_id", "group_id", "assigned_shards")


def active_instances(spark, sf_dir):
    return instances.with_liveness(views.heartbeats(spark, sf_dir), AS_OF).agg(
        F.count_if("is_active").alias("active_instances"))


def shard_assign(spark, sf_dir):
    return ownership.with_shard(views.order_state(spark, sf_dir).select("topic", "partition"))


def shard_balance(spark, sf_dir):
    return ownership.shard_balance(views.order_state(spark, sf_dir))


def shard_skew(spark, sf_dir):
    return ownership.shard_skew(views.order_state(spark, sf_dir))


def owned_partitions(spark, sf_dir):
    return ownership.owned_partitions(views.order_state(spark, sf_dir).select("topic", "partition"), [2, 5])


def topic_configs(spark, sf_dir):
    return configs.topic_configs(views.topic_config(spark, sf_dir), ["cleanup.policy", "segment.ms"])


def config_audit(spark, sf_dir):
    rows = views.topic_config(spark, sf_dir)
    return audit.config_findings(configs.topic_configs(rows), topics=rows.select("topic").distinct()).withColumn(
        "actual", F.coalesce("actual", F.lit("")))


def config_audit_summary(spark, sf_dir):
    """Findings by kind."""
    return audit.config_findings(views.topic_config(spark, sf_dir)).groupBy("name", "severity", "problem").agg(
        F.count(F.lit(1)).alias("topics"))


# -- streams ----------------------------------------------------------------------------------

def _feed(frame: DataFrame, parts: list, path: str, run: Callable[[], object]) -> None:
    """Append the parts of a frame one after the other and let the query catch up each time."""
    for part in parts:
        frame.where(part).write.mode("append").parquet(path)
        run().awaitTermination()


def _thirds(n) -> list:
    return [n <= 10, (n > 10) & (n <= 20), n > 20]


def _stream_topics(spark, sf_dir, start) -> str:
    log = _partial_log(spark, sf_dir)
    n = (F.unix_timestamp("timestamp") - F.lit(BASE)) / DAY
    source, out, checkpoint = (scratch_dir(spark, f"stream-{part}") for part in ("source", "out", "checkpoint"))
    _feed(log, _thirds(n), source, lambda: start(log_source.stream_table(spark, source), out, checkpoint))
    return out


def stream_merge(spark, sf_dir):
    out = _stream_topics(spark, sf_dir, live.topic_view)
    return live.read_partitions(spark, out)


def stream_merge_tables(spark, sf_dir):
    """As above with markers, the state compacted after every other batch."""
    out = _stream_topics(spark, sf_dir, partial(live.topic_view, compact_every=2))
    return _rows(live.read_topic_view(spark, out))


def stream_merge_resumed(spark, sf_dir):
    """The log up to scan 15 merged in one batch; a stream starts from that state and reads the rest."""
    log = _partial_log(spark, sf_dir)
    early = F.unix_timestamp("timestamp") <= F.lit(_at(15))
    initial = materialise(replay.merge_topics(log.where(early)), "initial-state")
    source, out, checkpoint = (scratch_dir(spark, f"stream-{part}") for part in ("source", "out", "checkpoint"))
    late = F.unix_timestamp("timestamp")
    _feed(log.where(~early), [late <= _at(20), late > _at(20)], source,
          lambda: live.topic_view(log_source.stream_table(spark, source), out, checkpoint, initial=initial))
    return _rows(live.read_topic_view(spark, out))


def stream_merge_by_offset(spark, sf_dir):
    """The log up to scan 15 merged in one batch; a tail by offset goes on from there, is stopped within the partitions and goes on again."""
    log = _partial_log(spark, sf_dir)
    early = log.where(F.unix_timestamp("timestamp") <= F.lit(_at(15)))
    out, positions = (scratch_dir(spark, f"tail-{part}") for part in ("out", "positions"))
    initial, resume = materialise(replay.merge_topics(early), "initial-state"), profile.resume_offsets(early)
    fold = live.topic_fold(out, initial)
    tail.follow(log, positions, fold, resume, per_partition=8 * views.OFFSETS_PER_SCAN + 500, steps=1)
    tail.follow(log, positions, fold)
    return _rows(live.read_topic_view(spark, out))


def _beat_changes(spark, sf_dir) -> DataFrame:
    """Every heartbeat, then a broken value for some users and a tombstone for others."""
    user = F.substring_index("key", "-", -1).cast("bigint")
    beats = views.heartbeat_records(spark, sf_dir).withColumn("offset", F.lit(0))
    broken = beats.where(user % 7 == 0).withColumn("value", F.lit("{not-json")).withColumn("offset", F.lit(1))
    gone = beats.where(user % 9 == 0).withColumn("value", F.lit(None).cast("string")).withColumn("offset", F.lit(2))
    return log_source.normalise(beats.unionByName(broken).unionByName(gone).select(
        "key", "value", F.lit(0).alias("partition"), "offset", F.timestamp_seconds(F.lit(AS_OF)).alias("timestamp")))


def _stream_beats(spark, log: DataFrame, parts: list, **options) -> DataFrame:
    source, out, checkpoint = (scratch_dir(spark, f"stream-{part}") for part in ("source", "out", "checkpoint"))
    _feed(log, parts, source,
          lambda: live.heartbeat_view(log_source.stream_table(spark, source), out, checkpoint, **options))
    return live.read_heartbeat_view(spark, out, AS_OF)


def stream_heartbeats(spark, sf_dir):
    """Heartbeats, broken values and tombstones from a stream."""
    offset = F.col("offset")
    return _stream_beats(spark, _beat_changes(spark, sf_dir), [offset == 0, offset >= 1])


def stream_heartbeats_resumed(spark, sf_dir):
    """The heartbeats replayed in one batch; a stream starts from these instances and reads the rest."""
    log, offset = _beat_changes(spark, sf_dir), F.col("offset")
    initial = materialise(replay.replay_heartbeats(log.where(offset == 0)), "initial-instances")
    return _stream_beats(spark, log.where(offset > 0), [offset == 1, offset == 2], initial=initial, compact_every=1)


def _scan_rows(spark, sf_dir) -> DataFrame:
    return materialise(scans.scan_rows(views.raw_listing(spark, sf_dir), views.observation(spark, sf_dir)), "scans")


def _run_scan_stream(spark, sf_dir) -> tuple[str, str]:
    rows = _scan_rows(spark, sf_dir)
    n = (F.col("scan_time") - F.lit(BASE)) / DAY
    source, state, log, checkpoint = (
        scratch_dir(spark, f"stream-{part}") for part in ("source", "state", "log", "checkpoint"))
    _feed(rows, _thirds(n), source,
          lambda: scans.start_scans(scans.read_scans(spark, source), state, log, checkpoint))
    return state, log


def stream_scan(spark, sf_dir):
    state, _ = _run_scan_stream(spark, sf_dir)
    return _rows(scans.read_scan_state(spark, state))


def stream_scan_replay(spark, sf_dir):
    """The state that a replay of the log written by the scan stream gives."""
    _, log = _run_scan_stream(spark, sf_dir)
    return _rows(replay.replay_topics(scans.read_scan_changelog(spark, log), AS_OF))


def stream_scan_split(spark, sf_dir):
    """All scans from files that cut across scans, one file per micro-batch."""
    rows = _scan_rows(spark, sf_dir)
    source, state, log, checkpoint = (
        scratch_dir(spark, f"stream-{part}") for part in ("source", "state", "log", "checkpoint"))
    piece = F.pmod(F.xxhash64("topic"), F.lit(4))
    rows.repartition(4, piece).write.parquet(source)
    scans.start_scans(scans.read_scans(spark, source, max_files_per_trigger=1), state, log, checkpoint).awaitTermination()
    return _rows(scans.read_scan_state(spark, state))


def _scans_with_loss(spark, sf_dir) -> str:
    """All scans; a third of the rows of scan 13 is lost, and comes after scan 30."""
    rows = _scan_rows(spark, sf_dir)
    lost = (F.col("scan_time") == _at(13)) & (F.pmod(F.xxhash64("topic", "partition"), F.lit(3)) == 0)
    source, state, log, checkpoint = (
        scratch_dir(spark, f"stream-{part}") for part in ("source", "state", "log", "checkpoint"))
    early = F.col("scan_time") <= _at(13)
    _feed(rows, [~lost & early, ~lost & ~early, lost], source,
          lambda: scans.start_scans(scans.read_scans(spark, source), state, log, checkpoint, compact_every=2))
    return state


def stream_scan_lost_rows(spark, sf_dir):
    """The state when scan 13 never becomes complete."""
    return _rows(scans.read_scan_state(spark, _scans_with_loss(spark, sf_dir)))


def stream_scan_ledger(spark, sf_dir):
    """What became of each of these scans."""
    return scans.read_scan_ledger(spark, _scans_with_loss(spark, sf_dir)).select("scan_time", "status", "expected")


def stream_scan_resumed(spark, sf_dir):
    """The records of scans 1 to 26 replayed, then scans 27 to 30 from a stream that starts from that state."""
    listing, observation = views.scans(spark, sf_dir)
    records = codec.encode_topics(history.state_as_of(observation, listing, _at(26)), _at(26))
    log = records.select("key", "value", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
                         F.timestamp_seconds(F.lit(_at(26))).alias("timestamp"))
    initial = materialise(replay.replay_topics(log, _at(26)), "initial-state")
    rows = _scan_rows(spark, sf_dir).where(F.col("scan_time") > _at(26))
    source, state, changes, checkpoint = (
        scratch_dir(spark, f"stream-{part}") for part in ("source", "state", "log", "checkpoint"))
    rows.write.parquet(source)
    scans.start_scans(scans.read_scans(spark, source), state, changes, checkpoint, initial=initial).awaitTermination()
    return _rows(scans.read_scan_state(spark, state))


def stream_scan_log(spark, sf_dir):
    """Replays of a scan stream's log after scans 10, 20 and 30."""
    _, path = _run_scan_stream(spark, sf_dir)
    log = scans.read_scan_changelog(spark, path)
    states = [
        _rows(replay.replay_topics(log.where(F.unix_timestamp("timestamp") <= F.lit(_at(n))), _at(n))).withColumn("n", F.lit(n))
        for n in (10, 20, 30)]
    return states[0].unionByName(states[1]).unionByName(states[2])


QUERIES: dict[str, Query] = {
    "unused_topics_from_log": unused_topics_from_log,
    "topic_listing": topic_listing,
    "listed_partition_counts": listed_partition_counts,
    "scan_latest_offsets": scan_latest_offsets,
    "scan_earliest_offsets": scan_earliest_offsets,
    "scan_watermarks": scan_watermarks,
    "offset_answers": offset_answers,
    "observation_join": observation_join,
    "last_change_backfill": last_change_backfill,
    "topic_epochs": topic_epochs,
    "state_as_of_scan": state_as_of_scan,
    "state_as_of_scan_with_deletions": state_as_of_scan_with_deletions,
    "last_change_incremental": last_change_incremental,
    "deleted_topics": deleted_topics,
    "scan_counters": scan_counters,
    "scan_cycle_records": scan_cycle_records,
    "topic_rollup": topic_rollup,
    "topic_status": topic_status,
    "stale_partitions": stale_partitions,
    "stale_by_topic": stale_by_topic,
    "age_parts": age_parts_of_orders,
    "age_text": age_text_of_orders,
    "list_topics_by_name": _list_orders(sort_by="name", sort_dir="desc", page=2, limit=500),
    "list_topics_by_partitions": _list_orders(sort_by="partitions", limit=500),
    "list_topics_by_age": _list_orders(sort_by="age", sort_dir="desc", limit=500),
    "list_topics_by_status": _list_orders(sort_by="status", sort_dir="desc", page=2, limit=500),
    "list_topics_by_messages": _list_orders(sort_by="messages", sort_dir="desc", search="CUST-1[0-9]+$"),
    "list_topics_by_empty": list_topics_by_empty,
    "list_topics_deep_page": list_topics_deep_page,
    "list_topics_indexed_pages": list_topics_indexed_pages,
    "unused_topics": unused_topics,
    "empty_topics": empty_topics,
    "page_meta": page_meta,
    "topic_detail": topic_detail,
    "topic_header": topic_header,
    "cluster_stats": cluster_stats,
    "list_report": list_report,
    "list_report_empty": list_report_empty,
    "list_documents": list_documents,
    "list_documents_wide": list_documents_wide,
    "list_header": list_header,
    "list_sub_rows": list_sub_rows,
    "topic_documents": topic_documents,
    "scan_summary": scan_summary,
    "name_match_prefix": _matched(lambda: name_matcher(F.col("name"), prefix="orders.cust-2")),
    "name_match_substring": _matched(lambda: name_matcher(F.col("name"), search="CUST-3")),
    "name_match_regex": _matched(lambda: name_matcher(F.col("name"), search="cust-(?:1|2)[0-9]*5$", regex=True)),
    "name_match_class": _matched(lambda: name_matcher(F.col("name"), search="cust-[[&&1]+[^*+&&1]*$", regex=True)),
    "topic_search_unicode": _matched(lambda: search_predicate(F.translate("name", "24679", "ÄäÖéЖ"), "(?i)CUST-[0-9]*[äж]+[0-9Ö]*É$")),
    "topic_search": _matched(lambda: search_predicate(F.col("name"), "ORDERS[.]cust-[0-9]*7$")),
    "changelog_records": changelog_records,
    "changelog_one_topic": changelog_one_topic,
    "changelog_wide_compacted": changelog_wide_compacted,
    "changelog_wide_replaced": changelog_wide_replaced,
    "changelog_wide_regrown": changelog_wide_regrown,
    "changelog_encode_replay": changelog_encode_replay,
    "changelog_merge": changelog_merge,
    "changelog_merge_topics": changelog_merge_topics,
    "state_merge": state_merge,
    "changelog_profile": changelog_profile,
    "changelog_profile_merged": changelog_profile_merged,
    "state_from_intervals": state_from_intervals,
    "partitions_with_data": partitions_with_data,
    "resume_offsets": resume_offsets,
    "heartbeat_liveness": heartbeat_liveness,
    "instance_prune": instance_prune,
    "live_instances": live_instances,
    "active_instances": active_instances,
    "shard_assign": shard_assign,
    "shard_balance": shard_balance,
    "shard_skew": shard_skew,
    "owned_partitions": owned_partitions,
    "topic_configs": topic_configs,
    "config_audit": config_audit,
    "config_audit_summary": config_audit_summary,
    "stream_merge": stream_merge,
    "stream_merge_tables": stream_merge_tables,
    "stream_merge_resumed": stream_merge_resumed,
    "stream_merge_by_offset": stream_merge_by_offset,
    "stream_heartbeats": stream_heartbeats,
    "stream_heartbeats_resumed": stream_heartbeats_resumed,
    "stream_scan": stream_scan,
    "stream_scan_replay": stream_scan_replay,
    "stream_scan_split": stream_scan_split,
    "stream_scan_lost_rows": stream_scan_lost_rows,
    "stream_scan_ledger": stream_scan_ledger,
    "stream_scan_resumed": stream_scan_resumed,
    "stream_scan_log": stream_scan_log,
}


def queries() -> dict[str, Query]:
    """Every query, run with the session settings of ``session.prepare``."""
    def prepared(query: Query) -> Query:
        return lambda spark, sf_dir: query(prepare(spark), sf_dir)
    return {name: prepared(query) for name, query in QUERIES.items()}
