"""State tables kept as changes.

A micro-batch writes only the rows it changed, into a folder named by its id, so what it writes
grows with the batch and a repeated batch replaces its own output.  A row that is gone is written
once more with ``deleted`` set.  Every ``every`` batches the newest rows become a new base and what
the base before it covers is deleted, so the table holds two bases and the changes since the older
one, however long the stream runs, and deleted rows leave it.

A read merges on the fly: changes are reduced to the newest row of each key, and hide the base row
of that key.  The base is not shuffled while the changes are small enough to be broadcast.  Reads
that need only some keys pass them; they are picked out before anything is merged.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.streaming.sinks import Folder

COMPACT_EVERY = 20
_BASE, _BATCH = "base=", "batch_id="


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, nulls equal, that keeps the columns of the left side."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, on, how)


@dataclass(frozen=True)
class ChangeStore:
    """A table of rows with unique ``keys`` under ``path``."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    every: int = COMPACT_EVERY

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("deleted", T.BooleanType()), T.StructField("version", T.LongType())])

    def _folder(self, spark: SparkSession) -> Folder:
        return Folder(spark, self.path)

    def start(self, initial: DataFrame) -> None:
        """The rows to begin with, such as a replayed log; they are older than every batch."""
        self._folder(initial.sparkSession).refuse_used()
        self._write(initial, f"{_BASE}-1", -1)

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        rows.withColumn("version", F.lit(version).cast("bigint")).select(*self._stored.names).write.mode("overwrite").parquet(
            f"{self.path}/{name}")

    def _parts(self, spark: SparkSession, upto: int | None) -> tuple[int | None, list[int]]:
        """(newest base, later batches) among those up to batch ``upto``."""
        folder = self._folder(spark)
        limit = float("inf") if upto is None else upto
        bases = [n for n in folder.numbers(_BASE) if n <= limit]
        base = max(bases, default=None)
        return base, sorted(n for n in folder.numbers(_BATCH) if n <= limit and (base is None or n > base))

    def _read(self, spark: SparkSession, names: list[str]) -> DataFrame:
        if not names:
            return spark.createDataFrame([], self._stored)
        return spark.read.schema(self._stored).parquet(*[f"{self.path}/{name}" for name in names])

    def last_batch(self, spark: SparkSession) -> int:
        """The newest batch, -1 before the first one."""
        base, batches = self._parts(spark, None)
        return max([*batches, -1 if base is None else base])

    def read(self, spark: SparkSession, upto: int | None = None, touched: DataFrame | None = None,
             then: Sequence[DataFrame] = ()) -> DataFrame:
        """The table after batch ``upto``, or after the newest one.

        ``touched`` has some key columns and restricts the rows; ``then`` are further sets of changes
        that are not written yet, each newer than the one before it.  ``version`` tells the batch that
        wrote a row; the sets of ``then`` count on from ``upto``.
        """
        base, batches = self._parts(spark, upto)
        start = max([-1 if upto is None else upto, *batches])
        changes = self._read(spark, [f"{_BATCH}{n}" for n in batches])
        for i, more in enumerate(then, start + 1):
            more = more if "deleted" in more.columns else more.withColumn("deleted", F.lit(False))
            changes = changes.unionByName(more.withColumn("version", F.lit(i).cast("bigint")).select(*self._stored.names))
        rows = self._read(spark, [] if base is None else [f"{_BASE}{base}"])
        if touched is not None:
            some = [k for k in self.keys if k in touched.columns]
            changes, rows = (same_keys(side, touched, some, "left_semi") for side in (changes, rows))
        keys = list(self.keys)
        if batches or then:
            body = [n for n in self._stored.names if n not in keys]
            changes = changes.groupBy(*keys).agg(F.max_by(F.struct(*body), "version").alias("row")).select(
                *keys, *[F.col(f"row.{n}").alias(n) for n in body])
            rows = changes if base is None else same_keys(rows, changes, keys, "left_anti").unionByName(changes)
        return rows.where(~F.col("deleted")).select(*self.schema.names, "version")

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """Write the changes of a batch; rows with ``deleted`` set are gone."""
        spark = changes.sparkSession
        folder = self._folder(spark)
        if batch_id == 0:
            folder.refuse_used()
        folder.remove(f"{_BASE}{batch_id}")  # of an attempt that failed
        self._write(changes, f"{_BATCH}{batch_id}", batch_id)
        if (batch_id + 1) % self.every == 0:
            self.compact(spark, batch_id)

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Make the table after ``batch_id`` a base and delete what the base before it covers.

        The older base and the changes since then stay: a restarted query may repeat the batch.
        """
        folder = self._folder(spark)
        older = max((n for n in folder.numbers(_BASE) if n < batch_id), default=None)
        rows = self.read(spark, batch_id)
        rows.withColumn("deleted", F.lit(False)).select(*self._stored.names).write.mode("overwrite").parquet(f"{self.path}/{_BASE}{batch_id}")
        if older is not None:
            for prefix, limit in ((_BASE, older - 1), (_BATCH, older)):
                for n in folder.numbers(prefix):
                    if n <= limit:
                        folder.remove(f"{prefix}{n}")
