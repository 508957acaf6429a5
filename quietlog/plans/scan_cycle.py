"""One whole scan as a batch job."""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.names import is_system_topic
from quietlog.operators.codec import encode_topics, topic_tombstones
from quietlog.operators.ownership import owned_partitions
from quietlog.operators.replay import replay_topics
from quietlog.operators.scan import fold_scan
from quietlog.schema import DEFAULT_SHARDS, STATE_COLUMNS
from quietlog.sources.tables import materialise


@dataclass(frozen=True)
class ScanOutcome:
    """``state`` after the scan and the ``records`` (key, value) to append to the log."""

    state: DataFrame
    records: DataFrame


def scan_once(changelog: DataFrame, listing: DataFrame, observations: DataFrame, scan_time: int,
              assigned: DataFrame | Iterable[int] | None = None,
              shard_count: int = DEFAULT_SHARDS) -> ScanOutcome | None:
    """Replay the log, fold one scan, and return what the scan writes.

    ``assigned`` restricts the work to the given shards.  None is returned, and nothing
    is to be written, when no listed partition is assigned; deleted topics are found
    against the full listing.
    """
    # The replayed state takes part twice, so the log is read and parsed once.
    previous = materialise(replay_topics(changelog, scan_time), "replayed-state")
    return scan_state(previous, listing, observations, scan_time, assigned, shard_count)


def scan_state(previous: DataFrame, listing: DataFrame, observations: DataFrame, scan_time: int,
               assigned: DataFrame | Iterable[int] | None = None,
               shard_count: int = DEFAULT_SHARDS) -> ScanOutcome | None:
    """As ``scan_once``, over a given previous state."""
    listing = listing.where(~is_system_topic(F.col("topic")))
    observations = observations.where(~is_system_topic(F.col("topic")))
    owned = listing.where(F.col("partition").isNotNull())
    if assigned is not None:
        owned = owned_partitions(owned, assigned, shard_count)
        observations = owned_partitions(observations, assigned, shard_count)
    if owned.isEmpty():
        return None
    result = fold_scan(previous, listing, observations, scan_time)
    records = encode_topics(result.state, scan_time, observed_only=True).select("key", "value")
    return ScanOutcome(result.state.select(*STATE_COLUMNS), records.unionByName(topic_tombstones(result.deleted, previous)))


def run_scan(changelog: DataFrame, listing: DataFrame, observations: DataFrame, scan_time: int,
             append: Callable[[DataFrame], None], **options) -> bool:
    """``scan_once`` and append its records with ``append``; whether a scan took place."""
    outcome = scan_once(changelog, listing, observations, scan_time, **options)
    if outcome is None:
        return False
    append(outcome.records)
    return True
