"""Where a cluster's intermediates go when its folders are on a file system that may be a local disk."""

import os
import uuid

import pytest

from spendlens.plans import store
from spendlens.plans.store import new_folder, work_dir, written


class Cluster:
    """The session of the tests as a cluster would show itself; of each table it writes, ``lost`` rows stay behind."""

    master, checkpoints = "spark://host:7077", None

    def __init__(self, spark, setting=None, warehouse=None, lost=0):
        self.spark, self.lost = spark, lost
        self.settings = {"spark.checkpoint.dir": setting, "spark.sql.warehouse.dir": warehouse}
        self.applicationId = uuid.uuid4().hex
        self.conf, self.sparkContext = self, self

    def get(self, key, default):
        return self.settings.get(key) or default

    def getCheckpointDir(self):
        return self.checkpoints

    def range(self, start, end, step, tasks):
        return self.spark.range(start, end - self.lost, step, tasks)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_a_mounted_folder_is_used_and_left_clean(spark, tmp_path):
    for folder in (f"file://{tmp_path}", f"file:{tmp_path}/", str(tmp_path)):
        assert work_dir(Cluster(spark, folder)) == folder.rstrip("/")
    assert os.listdir(tmp_path) == []
    cluster = Cluster(spark)
    cluster.checkpoints = f"file:{tmp_path}/of-context"
    assert work_dir(cluster) == cluster.checkpoints


def test_a_folder_that_loses_rows_is_refused(spark, tmp_path):
    with pytest.raises(RuntimeError):
        work_dir(Cluster(spark, f"file:{tmp_path}", f"file:{tmp_path}", lost=1))
    with pytest.raises(RuntimeError):
        work_dir(Cluster(spark, "file:/proc/no-such-folder"))


def test_the_warehouse_stands_in(spark, tmp_path):
    for setting in (None, "file:/proc/no-such-folder"):
        assert work_dir(Cluster(spark, setting, f"file:{tmp_path}")) == f"file:{tmp_path}"
    assert work_dir(Cluster(spark, None, "hdfs://x/warehouse")) == "hdfs://x/warehouse"


def test_executors_that_join_are_tried(spark, tmp_path, monkeypatch):
    tried, there = [], {"a:1"}
    monkeypatch.setattr(store, "_executors", lambda _: set(there))
    monkeypatch.setattr(store, "_comes_back", lambda spark, folder, tasks: tried.append(tasks) or len(there) < 3)
    cluster = Cluster(spark, f"file:{tmp_path}")
    assert work_dir(cluster) == work_dir(cluster) == f"file:{tmp_path}" and tried == [2]
    there.add("b:1")
    assert work_dir(cluster) == work_dir(cluster) == f"file:{tmp_path}" and tried == [2, 4]
    there.add("c:1")
    with pytest.raises(RuntimeError):
        work_dir(cluster)


def test_tables_are_written_there(spark, tmp_path):
    folder = new_folder(Cluster(spark, f"file://{tmp_path}"))
    assert folder.startswith(f"file://{tmp_path}/spendlens-")
    assert written(spark.range(100), f"{folder}/t").count() == 100
