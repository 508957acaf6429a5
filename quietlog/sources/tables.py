"""Small intermediate tables with exact sizes."""

from pyspark.sql import DataFrame

from quietlog.session import remove_scratch, scratch_dir


def materialise(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a reduced frame to the shared scratch folder and read it back.

    The optimizer then knows its true size from the files: a join broadcasts it
    when it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it when
    it is not.  The files outlive any executor.
    """
    return _written(frame, scratch_dir(frame.sparkSession, purpose))


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def join_side(side: DataFrame, rows: int) -> DataFrame:
    """One side of a join, which has up to ``rows`` rows: too many to be broadcast, and the join is a merge.

    Files are no measure of that: a table of topics and scans takes a hundredth of its rows' memory, and Spark, which
    goes by the files, would gather it in the driver.  A row counts what Spark takes it for where it knows their number.
    """
    limit = side.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return side.hint("merge") if 0 <= limit < rows * (8 + side._jdf.schema().defaultSize()) else side


class Scratch:
    """``materialise`` for tables that are needed within a block only, such as a micro-batch."""

    def __init__(self) -> None:
        self._held: list[tuple] = []

    def __enter__(self) -> "Scratch":
        return self

    def table(self, frame: DataFrame, purpose: str) -> DataFrame:
        path = scratch_dir(frame.sparkSession, purpose)
        self._held.append((frame.sparkSession, path))
        return _written(frame, path)

    def __exit__(self, *_) -> None:
        for spark, path in self._held:
            remove_scratch(spark, path)
