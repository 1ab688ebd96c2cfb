import datetime as dt
import os

import pytest

from spendlens.plans.store import _qualified, drop_folder, new_folder, read_by_month, work_dir, write_by_month, written


class Session:
    """The parts of a session that decide where intermediates go."""

    def __init__(self, master, setting=None):
        self.settings = {"spark.checkpoint.dir": setting} if setting else {}
        self.master, self.folder = master, None
        self.applicationId = f"app-{id(self)}"
        self.conf, self.sparkContext = self, self

    def get(self, key, default):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_the_shared_folder_of_the_cluster_is_used():
    session = Session("yarn", "hdfs:///shared/checkpoints/")
    assert work_dir(session) == "hdfs:///shared/checkpoints"
    first, second = new_folder(session), new_folder(session)
    assert first != second and first.startswith("hdfs:///shared/checkpoints/spendlens-")
    assert session.folder is None


def test_a_path_without_scheme_is_judged_by_the_default_file_system(spark):
    assert _qualified(spark, "/shared").startswith("file:/")
    assert _qualified(spark, "hdfs://x/shared") == "hdfs://x/shared"


def test_a_temporary_folder_only_in_local_mode():
    session = Session("local[2]")
    folder = work_dir(session)
    assert os.path.isdir(folder) and work_dir(session) == folder
    assert session.folder is None  # the context's own setting is left alone
    for setting in (None, "file:/tmp/checkpoints"):
        with pytest.raises(RuntimeError):
            work_dir(Session("spark://host:7077", setting))
    assert work_dir(Session("local-cluster[2,1,1024]", "file:/shared")) == "file:/shared"


def test_a_run_can_be_dropped(spark, tmp_path):
    path = str(tmp_path / "run")
    written(spark.range(3), f"{path}/t")
    drop_folder(spark, path)
    assert not os.path.exists(path)


def test_written_table_has_no_lineage_beyond_its_files(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 7 as k").groupBy("k").count()
    back = written(df, str(tmp_path / "t"))
    assert back.exceptAll(df).count() == 0
    text = back._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "FileScan" in text


def test_months_become_folders_with_days_in_order(spark, tmp_path):
    days = [(dt.date(2026, m, d), float(d)) for m in (1, 2, 12) for d in (20, 3, 11)]
    df = spark.createDataFrame(days + [(None, 1.0)], "date date, v double")
    path = str(tmp_path / "t")
    write_by_month(df, path)
    folders = sorted(f for f in os.listdir(path) if f.startswith("month="))
    assert folders[0] == "month=202601" and len(folders) == 4
    back = read_by_month(spark, path, df.schema)
    assert back.drop("month").exceptAll(df).count() == 0 and back.count() == 10
    january = spark.read.parquet(f"{path}/month=202601").collect()
    assert [r["date"].day for r in january] == [3, 11, 20]
