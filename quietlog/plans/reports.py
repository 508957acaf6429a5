"""Reports over a state table at an explicit instant (Q1-Q10, K6-K8).

Every report takes ``as_of`` (Unix seconds, or a column such as a scalar subquery) and
returns lazy DataFrames.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions.ages import age_days, age_parts, age_seconds, age_text, topic_age_days, topic_age_text, utc_text
from quietlog.functions.names import name_matcher, search_predicate
from quietlog.functions.status import topic_status, yes_no
from quietlog.operators.codec import SLICE_WIDTH
from quietlog.operators.instances import with_liveness
from quietlog.operators.ordering import page_meta, page_of, topic_order
from quietlog.operators.rollup import partitions_of, topic_rollup
from quietlog.arguments import Page, Thresholds, positive_int
from quietlog.schema import DEFAULT_STALE_DAYS


@dataclass(frozen=True)
class PagedReport:
    """``rows`` of one page and the one-row ``meta`` about all of them."""

    rows: DataFrame
    meta: DataFrame


def _topic_row(topics: DataFrame) -> DataFrame:
    """Columns of a topic in the paged reports."""
    return topics.select(
        "name", "partition_count",
        F.col("oldest_timestamp").alias("oldest_partition_timestamp"),
        F.col("newest_timestamp").alias("newest_partition_timestamp"),
        "is_empty", "total_message_count", "position")


def _before_rollup(state: DataFrame, predicate: Column | None) -> DataFrame:
    # The name is the grouping key, so name filters run before the shuffle.
    return state if predicate is None else state.where(predicate)


def _paged(state, as_of, only, search, sort_by, sort_dir, page, limit, thresholds) -> PagedReport:
    where = Page.of(page, limit)
    topics = topic_rollup(_before_rollup(state, search_predicate(F.col("topic"), search)))
    if only is not None:
        topics = topics.where(only)
    order = topic_order(as_of, thresholds, sort_by, sort_dir)
    return PagedReport(_topic_row(page_of(topics, order, where)), page_meta(topics, where))


def list_topics(state: DataFrame, as_of, search=None, sort_by=None, sort_dir=None, page=None, limit=None,
                stale_days=None, unused_days=None) -> PagedReport:
    """All topics (Q1)."""
    return _paged(state, as_of, None, search, sort_by, sort_dir, page, limit, Thresholds.of(stale_days, unused_days))


def unused_topics(state: DataFrame, as_of, search=None, sort_by=None, sort_dir=None, page=None, limit=None,
                  stale_days=None, unused_days=None) -> PagedReport:
    """Topics whose newest partition is at least ``unused_days`` old."""
    thresholds = Thresholds.of(stale_days, unused_days)
    only = topic_age_days(F.col("newest_timestamp"), as_of) >= thresholds.unused_days
    return _paged(state, as_of, only, search, sort_by, sort_dir, page, limit, thresholds)


def empty_topics(state: DataFrame, as_of, search=None, sort_by=None, sort_dir=None, page=None, limit=None,
                 stale_days=None, unused_days=None) -> PagedReport:
    """Topics that have partitions, all of them empty."""
    return _paged(state, as_of, F.col("is_empty"), search, sort_by, sort_dir, page, limit,
                  Thresholds.of(stale_days, unused_days))


def topic_detail(state: DataFrame, name: str) -> DataFrame:
    """One row per partition of one topic, none if the topic is unknown.

    Rows stay flat: a topic with very many partitions is never gathered into one value.
    """
    return (
        partitions_of(state.where(F.col("topic") == name))
        .select("topic", "partition", "offset", "timestamp", "is_empty", "message_count")
        .orderBy("partition")
    )


def topic_header(state: DataFrame, name: str) -> DataFrame:
    """Header row of one topic (Q2)."""
    return topic_rollup(state.where(F.col("topic") == name)).select(
        "name", "partition_count", "oldest_timestamp", "newest_timestamp", "last_update", "is_empty")


def stale_partitions(state: DataFrame, as_of, stale_days=None) -> DataFrame:
    """Partitions of at least ``stale_days`` of age."""
    days = DEFAULT_STALE_DAYS if stale_days is None else positive_int(stale_days, "stale_days")
    age = age_days(F.col("timestamp"), as_of)
    return partitions_of(state).where(age >= days).select(
        "topic", "partition", "offset", age_text(age_seconds(F.col("timestamp"), as_of)).alias("age"),
        age.alias("age_days"), "message_count")


def status_report(state: DataFrame, as_of, stale_days=None, unused_days=None) -> DataFrame:
    """All topics with status, age in days and number of stale partitions."""
    limits = Thresholds.of(stale_days, unused_days)
    oldest, newest = F.col("oldest_timestamp"), F.col("newest_timestamp")
    return topic_rollup(state, as_of, limits.stale_days).withColumns({
        "status": topic_status(oldest, newest, as_of, limits.stale_days, limits.unused_days),
        "newest_days": topic_age_days(newest, as_of),
        "oldest_days": topic_age_days(oldest, as_of),
    })


def cluster_stats(state: DataFrame, as_of, instances: DataFrame | None = None, last_scan=None,
                  stale_days=None, unused_days=None, is_global: bool = True,
                  local_instance_id: str = "") -> DataFrame:
    """One row of cluster figures.

    Stale partitions are counted over all topics.  ``instances`` is a frame with
    ``is_active``; its count is added by a union of two one-row frames.
    """
    limits = Thresholds.of(stale_days, unused_days)
    topics = topic_rollup(state, as_of, limits.stale_days)
    unused = topic_age_days(F.col("newest_timestamp"), as_of) >= limits.unused_days
    figures = topics.agg(
        F.count(F.lit(1)).alias("total_topics"),
        F.coalesce(F.sum("partition_count"), F.lit(0)).cast("bigint").alias("total_partitions"),
        F.count_if(unused).alias("unused_topics"),
        F.coalesce(F.sum("stale_partitions"), F.lit(0)).cast("bigint").alias("stale_partitions"),
        F.max("last_update").alias("last_scan"),
        F.lit(0).cast("bigint").alias("active_instances"),
    )
    if instances is not None:
        active = instances.agg(F.count_if("is_active").alias("active_instances"))
        figures = figures.unionByName(active, allowMissingColumns=True).agg(
            *[F.max(name).alias(name) for name in figures.columns])
    scan = F.col("last_scan") if last_scan is None else F.lit(last_scan).cast("bigint")
    return figures.select(
        "total_topics", "total_partitions", "unused_topics", "stale_partitions",
        F.lit(limits.stale_days).alias("stale_days"), F.lit(limits.unused_days).alias("unused_days"),
        "active_instances", scan.alias("last_scan"),
        F.lit(is_global).alias("is_global"), F.lit(local_instance_id).alias("local_instance_id"))


def list_report(state: DataFrame, as_of, prefix=None, search=None, regex: bool = False, empty_only: bool = False,
                stale_days=None, unused_days=None) -> DataFrame:
    """The list report: unused topics, or empty ones of any age.

    Sorted by newest age in days descending, then name (T2).
    """
    limits = Thresholds.of(stale_days, unused_days)
    named = _before_rollup(state, name_matcher(F.col("topic"), prefix, search, regex))
    topics = status_report(named, as_of, limits.stale_days, limits.unused_days)
    topics = topics.where(F.col("is_empty") if empty_only else F.col("newest_days") >= limits.unused_days)
    return topics.select(
        "name", "status", "is_empty", yes_no(F.col("is_empty")).alias("empty"), "partition_count",
        "stale_partitions", "total_message_count",
        topic_age_text(F.col("oldest_timestamp"), as_of).alias("oldest_partition_age"),
        topic_age_text(F.col("newest_timestamp"), as_of).alias("newest_partition_age"),
        "newest_days", F.col("last_update").alias("last_update_unix"),
    ).orderBy(F.col("newest_days").desc(), "name")


def list_sub_rows(report: DataFrame, state: DataFrame, as_of, stale_days=None) -> DataFrame:
    """Stale partitions of the topics of a list report, as flat sub-rows (K8)."""
    names = report.select(F.col("name").alias("topic"))
    return stale_partitions(state, as_of, stale_days).join(names, "topic", "left_semi").select(
        "topic", "partition", "offset", "age", "message_count")


def _numbered(nested: DataFrame) -> DataFrame:
    """Lines of a topic with their number (``slice``) and how many there are (``slices``)."""
    lines = Window.partitionBy("name")
    return nested.withColumns({
        "slices": F.count(F.lit(1)).over(lines),
        "slice": (F.row_number().over(lines.orderBy("slice")) - 1).cast("bigint")})


def _line_numbers() -> list[Column]:
    """``slice`` and ``slices``; a topic without nested rows has one line."""
    return [F.coalesce("slice", F.lit(0)).alias("slice"), F.coalesce("slices", F.lit(1)).alias("slices")]


def list_documents(report: DataFrame, state: DataFrame | None = None, as_of=None, stale_days=None,
                   slice_width: int = SLICE_WIDTH) -> DataFrame:
    """The list report as JSON, one line per topic (K6).

    With a state, ``stale_partition_details`` are nested.  A topic gets one line per
    range of ``slice_width`` partition numbers that holds stale ones, so that no line
    grows without bound; every line says which it is of how many.
    """
    details = F.lit(None)
    lines = report.withColumns({"slice": F.lit(0).cast("bigint"), "slices": F.lit(1).cast("bigint")})
    if state is not None:
        item = F.struct("partition", "offset", "age", "message_count")
        nested = (
            list_sub_rows(report, state, as_of, stale_days)
            .withColumn("slice", F.floor(F.col("partition") / F.lit(slice_width)))
            .groupBy(F.col("topic").alias("name"), "slice")
            .agg(F.sort_array(F.collect_list(item)).alias("details"))
        )
        lines = report.join(_numbered(nested), "name", "left")
        details = F.col("details")
    return lines.select("name", F.to_json(F.struct(
        "name", "status", "is_empty", "partition_count", "oldest_partition_age", "newest_partition_age",
        "stale_partitions", "total_message_count", "last_update_unix", details.alias("stale_partition_details"),
        *_line_numbers(),
    ), {"ignoreNullFields": "true"}).alias("document"))


def list_header(report: DataFrame, generated_at) -> DataFrame:
    """``generated_at`` and ``count`` of a list report."""
    when = generated_at if isinstance(generated_at, Column) else F.lit(generated_at).cast("bigint")
    return report.agg(F.count(F.lit(1)).alias("count")).select(utc_text(when).alias("generated_at"), "count")


def write_documents(documents: DataFrame, path: str, fmt: str = "text") -> None:
    """Write JSON lines in parallel, one file per task (K6)."""
    documents.select("document").write.mode("overwrite").format(fmt).save(path)


def scan_summary(state: DataFrame, as_of, prefix=None, search=None, regex: bool = False,
                 stale_days=None, unused_days=None) -> DataFrame:
    """Topics written, topics matched and unused ones among the matched (Q7, K7, A10)."""
    limits = Thresholds.of(stale_days, unused_days)
    matched = name_matcher(F.col("name"), prefix, search, regex)
    matched = F.lit(True) if matched is None else matched
    is_unused = F.col("status") == "unused"
    return status_report(state, as_of, limits.stale_days, limits.unused_days).agg(
        F.count(F.lit(1)).alias("total_topics"),
        F.count_if(matched).alias("match_count"),
        F.count_if(matched & is_unused).alias("unused_count"),
    )


def topic_documents(state: DataFrame, as_of, prefix=None, search=None, regex: bool = False,
                    slice_width: int = SLICE_WIDTH) -> DataFrame:
    """Matched topics with their partitions as JSON lines (Q7, K7).

    Lines are sliced by partition number as in ``list_documents``.
    """
    named = _before_rollup(state, name_matcher(F.col("topic"), prefix, search, regex))
    topics = topic_rollup(named)
    part = F.struct(
        "partition", "offset", "timestamp", age_parts(age_seconds(F.col("timestamp"), as_of)).alias("age"),
        "is_empty", F.nullif(F.col("scanned_at"), F.lit(0)).alias("scanned_at"), "message_count")
    nested = (
        partitions_of(named)
        .withColumn("slice", F.floor(F.col("partition") / F.lit(slice_width)))
        .groupBy(F.col("topic").alias("name"), "slice")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct(F.col("partition").cast("string").alias("key"), part.alias("value"))))).alias("partitions"))
    )

    def age(name):
        elapsed = F.when(F.col(name) > 0, age_seconds(F.col(name), as_of)).otherwise(F.lit(0).cast("bigint"))
        return age_parts(elapsed)

    return topics.join(_numbered(nested), "name", "left").select("name", F.to_json(F.struct(
        "name", "partition_count", "partitions", age("oldest_timestamp").alias("oldest_partition_age"),
        age("newest_timestamp").alias("newest_partition_age"), "last_update", "is_empty", "total_message_count",
        *_line_numbers(),
    )).alias("document"))


def instances(heartbeats: DataFrame, as_of) -> DataFrame:
    """Instances with their liveness, by id."""
    return with_liveness(heartbeats, as_of).orderBy("instance_id")
