"""The tail of a table-backed log by offset.

Where a stream of files knows only which files it has read, a tail knows the next offset of every
changelog partition, so it can start where a batch replay ended (``resume_offsets``), in the middle
of a file or of a partition.  Each step reads a range of offsets per partition, folds it and then notes
how far it came; positions are a table kept as changes.  A step that is repeated after a failure
starts from the same positions and replaces what it wrote, so nothing is skipped or counted twice.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.streaming.store import ChangeStore

POSITION = T.StructType([
    T.StructField("partition", T.IntegerType()),
    T.StructField("next_offset", T.LongType()),
    T.StructField("records", T.LongType()),
])


def _positions(path: str) -> ChangeStore:
    return ChangeStore(path, POSITION, ("partition",))


def follow(log: DataFrame, path: str, fold: Callable[[DataFrame, int], None], resume: DataFrame | None = None,
           per_partition: int | None = None, steps: int | None = None) -> int:
    """Fold what ``log`` holds beyond the positions under ``path``; the number of steps taken.

    ``log`` is a batch frame of the changelog, read anew for each call.  ``fold`` takes the records of a step and
    its number, as ``live.topic_fold`` does.  ``resume`` is (partition, next_offset) for the first call; partitions
    it does not name are read from their start.  A step takes at most ``per_partition``
    consecutive offsets of each partition, and a call at most ``steps`` steps.
    """
    spark, store = log.sparkSession, _positions(path)
    step = store.last_batch(spark) + 1
    if step == 0 and resume is not None:
        store.start(resume.select("partition", "next_offset", F.lit(0).cast("bigint").alias("records")))
    taken = 0
    while steps is None or taken < steps:
        # One row per changelog partition, here and below.
        known = {r["partition"]: r["next_offset"] for r in store.read(spark, step - 1).collect()}
        later = _beyond(log, known)
        bounds = later.groupBy("partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last")).collect()
        if not bounds:
            break
        ends = {r["partition"]: r["last"] + 1 if per_partition is None else min(r["last"] + 1, r["first"] + per_partition) for r in bounds}
        end = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
        batch = later.where(F.col("offset") < end[F.col("partition")])
        fold(batch, step)
        counts = batch.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"), F.count(F.lit(1)).alias("records"))
        store.write(counts, step)
        step, taken = step + 1, taken + 1
    return taken


def _beyond(log: DataFrame, known: dict[int, int]) -> DataFrame:
    """Records at or after the known offset of their partition; the least of these reaches the scan."""
    if not known:
        return log
    start = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    own = F.col("offset") >= F.coalesce(start[F.col("partition")], F.lit(0))
    named = F.col("partition").isin(*known)
    return log.where((~named | (F.col("offset") >= min(known.values()))) & own)


def read_positions(spark, path: str) -> DataFrame:
    """(partition, next_offset) up to which the tail has read."""
    return _positions(path).read(spark).select("partition", "next_offset")
