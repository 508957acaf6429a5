"""Idempotent table sinks of the streaming jobs.

Every micro-batch writes a folder of its own, named by the batch id, so a batch that
is run again after a failure replaces what it wrote before.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Folder:
    """The numbered folders below a path, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self._path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, prefix: str, complete: bool = True) -> list[int]:
        """Numbers of the folders ``<prefix><number>`` that were written to the end."""
        if not self._files.exists(self._at(self._path)):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._at(self._path))]
        return sorted(
            int(name.removeprefix(prefix)) for name in names if name.startswith(prefix)
            and (not complete or self._files.exists(self._at(f"{self._path}/{name}/_SUCCESS"))))

    def remove(self, name: str) -> None:
        self._files.delete(self._at(f"{self._path}/{name}"), True)

    def refuse_used(self) -> None:
        """A new query must not continue in the folder of another one, whose later batches would hide its own."""
        if any(n > 0 for n in self.numbers("batch_id=", complete=False)):
            raise ValueError(f"{self._path} holds batches of another query; use a new folder with a new checkpoint")


def batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def write_batch(frame: DataFrame, path: str, batch_id: int) -> None:
    if batch_id == 0:
        Folder(frame.sparkSession, path).refuse_used()
    frame.write.mode("overwrite").parquet(batch_path(path, batch_id))


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """What batch ``batch_id`` wrote; an empty frame before the first batch."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_path(path, batch_id))


def drop_batches(spark: SparkSession, path: str, before: int) -> None:
    """Delete what batches below ``before`` wrote."""
    folder = Folder(spark, path)
    for n in folder.numbers("batch_id=", complete=False):
        if n < before:
            folder.remove(f"batch_id={n}")
