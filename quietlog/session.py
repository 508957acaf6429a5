"""Session settings the jobs rely on, and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    # Zone-free TIMESTAMP columns are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Stateful operators keep their state off the heap, with changelog checkpoints.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session; cluster sizing stays as it is."""
    for name, value in SQL_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


_local_base: str | None = None


def _shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder: the setting, else the session's checkpoint directory."""
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors share; a folder of one machine would lose rows")
    _local_base = _local_base or tempfile.mkdtemp(prefix="quietlog-")
    return _local_base


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared folder.

    Only on a local master, with neither ``spark.checkpoint.dir`` nor a checkpoint
    directory set, is a local temporary folder used.
    """
    return f"{_shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder, through Spark's own file system layer."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
