"""Last-change times over many scans.

A (topic, partition) pair appears at most once per scan, so the windows below hold at
most one row per scan; a topic that holds most of the rows is spread over its
partitions.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions.offsets import is_empty, message_count
from quietlog.schema import STATE_COLUMNS
from quietlog.sources.tables import join_side, materialise


def topic_epochs(listing: DataFrame) -> DataFrame:
    """(topic, scan_time, is_return, epoch) of every scan that lists the topic.

    A successful scan is one that appears in the listing.  A topic not listed at such
    a scan loses its state; when it is listed again a new epoch begins.
    """
    seen = listing.select("topic", "scan_time").distinct()
    # One row per scan of the cluster: small, and independent of topics and partitions.
    scans = listing.select("scan_time").distinct().withColumn(
        "previous_scan", F.lag("scan_time").over(Window.orderBy("scan_time")))
    by_topic = Window.partitionBy("topic").orderBy("scan_time")
    return (
        seen.join(scans, "scan_time")
        .withColumn("last_seen", F.lag("scan_time").over(by_topic))
        .withColumn("is_return", F.coalesce(F.col("last_seen") != F.col("previous_scan"), F.lit(False)))
        .withColumn("epoch", F.sum(F.col("is_return").cast("int")).over(
            by_topic.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
        .select("topic", "scan_time", "is_return", "epoch")
    )


def returns_of(epochs: DataFrame, table: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """(topic, returns): scan times at which deleted topics came back.

    Only recreated topics have a row and an array holds at most one entry per scan.
    The frame is written out so that joins know its size.
    """
    returns = epochs.where("is_return").groupBy("topic").agg(F.sort_array(F.collect_list("scan_time")).alias("returns"))
    return table(returns, "topic-returns")


def topic_returns(listing: DataFrame) -> DataFrame:
    """``returns_of`` the epochs of a listing."""
    return returns_of(topic_epochs(listing))


def _epoch_at(time: Column) -> Column:
    return F.coalesce(F.array_size(F.filter("returns", lambda back: back <= time)), F.lit(0))


def last_change_history(observations: DataFrame, returns: DataFrame) -> DataFrame:
    """State of every observed partition after every scan.

    The timestamp is the latest scan at which the offset had moved forward against the
    previous answer, or the first scan of the epoch.  Comparison is with the previous
    answer, not with the highest: 100, 95, 96 moves at 96.  Rows without an answer stay
    in the frame with a null offset.
    """
    by_scan = Window.partitionBy("topic", "partition", "epoch").orderBy("scan_time")
    latest = F.col("latest")
    previous = F.last("latest", ignorenulls=True).over(by_scan.rowsBetween(Window.unboundedPreceding, -1))
    moved = latest.isNotNull() & (F.col("previous").isNull() | (latest > F.col("previous")))
    earliest = F.coalesce(F.col("earliest"), F.lit(0))
    return (
        observations.join(returns, "topic", "left")
        .withColumn("epoch", _epoch_at(F.col("scan_time")))
        .withColumn("previous", previous)
        .withColumn("timestamp", F.last(F.when(moved, F.col("scan_time")), ignorenulls=True).over(
            by_scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(
            "topic", "partition", "epoch", "scan_time",
            latest.alias("offset"),
            "timestamp",
            is_empty(latest, earliest).alias("is_empty"),
            message_count(latest, earliest).alias("message_count"),
        )
    )


def state_as_of(observations: DataFrame, listing: DataFrame, scan_time: int,
                returns: DataFrame | None = None) -> DataFrame:
    """State table after the scan at ``scan_time``.

    The last answered row of each partition in the epoch that is live at that scan;
    partitions that were not answered at the scan keep their row.  A topic that was
    answered without a single usable offset is a marker row.
    """
    listing = listing.where(F.col("scan_time") <= scan_time)
    observations = observations.where(F.col("scan_time") <= scan_time)
    if returns is None:
        returns = topic_returns(listing)
    live = (
        listing.where(F.col("scan_time") == scan_time).select("topic").distinct()
        .join(returns, "topic", "left")
        .select("topic", _epoch_at(F.lit(scan_time)).alias("epoch"))
    )
    answered = F.when(F.col("offset").isNotNull(), F.col("scan_time"))
    latest = (
        last_change_history(observations, returns)
        .groupBy("topic", "partition", "epoch")
        .agg(
            F.max_by("offset", answered).alias("offset"),
            F.max_by("timestamp", answered).alias("timestamp"),
            F.max_by("is_empty", answered).alias("is_empty"),
            F.max(answered).alias("scanned_at"),
            F.max_by("message_count", answered).alias("message_count"),
            F.max("scan_time").alias("last_update"),
        )
        .join(live, ["topic", "epoch"], "left_semi")
    )
    return latest.withColumn(
        "partition", F.when(F.col("offset").isNotNull(), F.col("partition"))).select(*STATE_COLUMNS)


@dataclass(frozen=True)
class ScansResult:
    """``state`` after the last scan, with an ``observed`` flag; ``deleted`` topics."""

    state: DataFrame
    deleted: DataFrame


def resume_scans(previous: DataFrame, listing: DataFrame, observations: DataFrame,
                 first_scan: int, last_scan: int) -> ScansResult:
    """Fold all scans from ``first_scan`` to ``last_scan`` into a state table in one pass.

    The previous state takes part as if it were an answer given just before the first
    scan.  ``deleted`` are its topics that were missing from a listing since then, also
    those that are back by now; their tombstones come before the new records.
    """
    before = first_scan - 1
    known = previous.select("topic").distinct().withColumn("scan_time", F.lit(before).cast("bigint"))
    # The epochs feed three small results, so they are written out once.
    epochs = materialise(topic_epochs(listing.select("topic", "scan_time").unionByName(known)), "topic-epochs")
    returns = returns_of(epochs)
    live = epochs.where(F.col("scan_time") == last_scan).select("topic", "epoch")
    gone = (
        epochs.where(F.col("epoch") == 0).groupBy("topic")
        .agg(F.min("scan_time").alias("since"), F.max("scan_time").alias("until"))
        .where((F.col("since") == before) & (F.col("until") < last_scan))
    )

    seeds = previous.select(
        "topic", "partition", F.lit(before).cast("bigint").alias("scan_time"),
        F.col("offset").alias("latest"), F.lit(None).cast("bigint").alias("earliest"),
        F.struct("timestamp", "is_empty", "scanned_at", "message_count", "last_update").alias("seed"))
    rows = observations.select("topic", "partition", "scan_time", "latest", "earliest").withColumn(
        "seed", F.lit(None).cast(seeds.schema["seed"].dataType)).unionByName(seeds)

    by_scan = Window.partitionBy("topic", "partition", "epoch").orderBy("scan_time")
    latest, seed, earliest = F.col("latest"), F.col("seed"), F.coalesce(F.col("earliest"), F.lit(0))
    # A seed with an unset timestamp counts as no previous answer.
    compared = F.when(seed.isNull() | (seed["timestamp"] != 0), latest)
    moved = latest.isNotNull() & (F.col("previous").isNull() | (latest > F.col("previous")))
    changed = F.when(seed.isNotNull(), seed["timestamp"]).otherwise(F.when(moved, F.col("scan_time")))
    answered = F.when(latest.isNotNull(), F.col("scan_time"))

    def last(fresh: Column, name: str) -> Column:
        value = F.when(seed.isNotNull(), seed[name]).otherwise(fresh)
        return F.max_by(value, answered).alias(name)

    state = (
        rows.join(returns, "topic", "left")
        .withColumn("epoch", _epoch_at(F.col("scan_time")))
        .withColumn("previous", F.last(compared, ignorenulls=True).over(
            by_scan.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("changed_at", F.last(changed, ignorenulls=True).over(
            by_scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("topic", "partition", "epoch")
        .agg(
            F.max_by(latest, answered).alias("offset"),
            F.max_by("changed_at", answered).alias("timestamp"),
            last(is_empty(latest, earliest), "is_empty"),
            last(F.col("scan_time"), "scanned_at"),
            last(message_count(latest, earliest), "message_count"),
            F.max(F.coalesce(seed["last_update"], F.when(seed.isNull(), F.col("scan_time")))).alias("last_update"),
            F.bool_or(seed.isNull()).alias("observed"),
        )
        .join(live, ["topic", "epoch"], "left_semi")
        .withColumn("partition", F.when(F.col("offset").isNotNull(), F.col("partition")))
    )
    return ScansResult(state.select(*STATE_COLUMNS, "observed"), gone.select("topic"))


@dataclass(frozen=True)
class ScansFold:
    """What several scans did to a state.

    ``changed``: state rows that are new, different or gone (``deleted``), the last ones only;
    ``versions``: the rows of every topic after each scan that processed it, with ``scan_time``,
    and ``observed`` where that scan answered them; ``ended``: (topic, scan_time) of deletions.
    """

    changed: DataFrame
    versions: DataFrame
    ended: DataFrame


def fold_scans(previous: DataFrame, listing: DataFrame, observations: DataFrame, scan_times: Sequence[int],
               table: Callable[[DataFrame, str], DataFrame] = materialise) -> ScansFold:
    """As ``fold_scan`` for each of ``scan_times`` in turn, in one pass whatever their number.

    ``observations`` has a row per asked partition; a topic is processed by the scans that asked
    for it.  Intermediate tables are written by ``table``; joins with them go by their rows (``join_side``).
    """
    first, before = min(scan_times), min(scan_times) - 1
    known = previous.select("topic").distinct().withColumn("scan_time", F.lit(before).cast("bigint"))
    epochs = table(topic_epochs(listing.select("topic", "scan_time").unionByName(known)), "topic-epochs")
    returns = returns_of(epochs, table)
    listed = epochs.count()
    processed = table(
        observations.select("topic", "scan_time").distinct().join(
            join_side(epochs.select("topic", "scan_time", "epoch"), listed), ["topic", "scan_time"]),
        "processed-topics")
    asked = processed.count()
    live = epochs.where(F.col("scan_time") == max(scan_times)).select("topic", "epoch")
    live = join_side(live, live.count())
    # An epoch ends at the scan after its last listing; only topics of the state are deleted.
    times = F.array(*[F.lit(t).cast("bigint") for t in sorted(scan_times)])
    ends = epochs.groupBy("topic", "epoch").agg(F.max("scan_time").alias("until")).withColumn(
        "scan_time", F.get(F.filter(times, lambda t: t > F.col("until")), F.lit(0)))
    held = processed.select("topic", "epoch").unionByName(
        epochs.where((F.col("scan_time") == before) & (F.col("epoch") == 0)).select("topic", "epoch")).distinct()
    ended = table(ends.where(F.col("scan_time").isNotNull()).join(
        join_side(held, listed), ["topic", "epoch"], "left_semi").select("topic", "epoch", "scan_time"), "ended-topics")

    answers = observations.where(F.col("latest").isNotNull())
    earliest = F.coalesce(F.col("earliest"), F.lit(0))
    fresh = answers.select(
        "topic", "partition", "scan_time", F.col("latest").alias("offset"), F.lit(None).cast("bigint").alias("timestamp"),
        is_empty(F.col("latest"), earliest).alias("is_empty"), F.col("scan_time").alias("scanned_at"),
        message_count(F.col("latest"), earliest).alias("message_count"), F.col("scan_time").alias("last_update"))
    seeds = previous.where(F.col("partition").isNotNull()).join(
        join_side(processed.select("topic").distinct(), asked), "topic", "left_semi").select(*[
        F.lit(before).cast("bigint").alias("scan_time") if n == "scan_time" else F.col(n) for n in fresh.columns])
    by_scan = Window.partitionBy("topic", "partition", "epoch").orderBy("scan_time")
    is_seed, offset = F.col("scan_time") < first, F.col("offset")
    # A seed with an unset timestamp counts as no previous answer.
    compared = F.when(~is_seed | (F.col("timestamp") != 0), offset)
    moved = F.col("previous").isNull() | (offset > F.col("previous"))
    changed_at = F.when(is_seed, F.col("timestamp")).otherwise(F.when(moved, F.col("scan_time")))
    rows = table(
        fresh.unionByName(seeds).join(returns, "topic", "left")
        .withColumn("epoch", _epoch_at(F.col("scan_time"))).drop("returns")
        .withColumn("previous", F.lag(compared).over(by_scan))
        .withColumn("until", F.lead("scan_time").over(by_scan))
        .withColumn("timestamp", F.last(changed_at, ignorenulls=True).over(
            by_scan.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("previous"), "scanned-rows")

    last = rows.where(F.col("until").isNull() & ~is_seed).join(live, ["topic", "epoch"], "left_semi").select(*STATE_COLUMNS)
    markers = processed.join(live, ["topic", "epoch"], "left_semi").groupBy("topic").agg(F.max("scan_time").alias("last_update"))
    now = last.unionByName(markers, allowMissingColumns=True)
    lost = previous.join(ended.where("epoch = 0").select("topic"), "topic", "left_semi")
    changed = now.withColumn("deleted", F.lit(False)).unionByName(
        lost.join(join_side(now.select(F.col("topic").alias("t"), F.col("partition").alias("p")), rows.count() + asked),
                  (F.col("topic") == F.col("t")) & F.col("partition").eqNullSafe(F.col("p")), "left_anti")
        .select(*STATE_COLUMNS).withColumn("deleted", F.lit(True)))

    kept = rows.withColumnRenamed("scan_time", "since").withColumn("scan_time", F.explode(
        F.filter(times, lambda t: (t >= F.col("since")) & (F.col("until").isNull() | (t < F.col("until"))))))
    kept = kept.join(join_side(processed, asked), ["topic", "epoch", "scan_time"], "left_semi").withColumn("observed", F.col("since") == F.col("scan_time"))
    versions = kept.select(*STATE_COLUMNS, "scan_time", "observed").unionByName(
        processed.select("topic", "scan_time", F.lit(True).alias("observed")), allowMissingColumns=True)
    return ScansFold(changed, versions, ended.select("topic", "scan_time"))
