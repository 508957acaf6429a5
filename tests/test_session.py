"""Where intermediate tables go."""

import pytest

from quietlog import session


class FakeContext:
    def __init__(self, spark, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint
        self._jsc = self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.checkpoint is not None

    def get(self):
        return self.checkpoint


class FakeSession:
    """A session whose settings and master the test chooses."""

    def __init__(self, master, setting=None, checkpoint=None):
        self.setting, self.conf = setting, self
        self.sparkContext = FakeContext(self, master, checkpoint)

    def get(self, name, default=None):
        return self.setting if name == "spark.checkpoint.dir" else default


def test_the_setting_comes_first():
    fake = FakeSession("spark://host:1", "s3://shared/", "/other")
    assert session.scratch_dir(fake, "x").startswith("s3://shared/x-")


def test_the_checkpoint_directory_of_the_session_comes_next():
    assert session.scratch_dir(FakeSession("yarn", None, "hdfs://n/c"), "x").startswith("hdfs://n/c/x-")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_masters_may_use_a_local_folder(master):
    assert "/quietlog-" in session.scratch_dir(FakeSession(master), "x")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.scratch_dir(FakeSession(master), "x")


def test_scratch_is_removed(spark):
    path = session.scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    session.remove_scratch(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
