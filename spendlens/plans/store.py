"""Written intermediates.

A table several jobs share is written once into the folder the cluster names for
checkpoints and read back, so a lost executor costs a re-read and never a
recomputation of the cleaning layer.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.plans.observed import write_observed

MONTH = "month"

# Folders made for local sessions without a setting, by application.
_temporary: dict[str, str] = {}

# Executors that were seen to reach a folder, by application and folder.
_reached: dict[tuple[str, str], set[str]] = {}


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; without one it is on the default file system, which may be a local disk."""
    if ":" in path.split("/", 1)[0]:
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _executors(spark: SparkSession) -> set[str]:
    """The processes that hold data of the application, the driver among them."""
    known = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    return {f"{x.host()}:{x.port()}" for x in known}


def _comes_back(spark: SparkSession, folder: str, tasks: int) -> bool:
    """Whether a row from each task, written to a folder, is found again."""
    trial = f"{folder}/spendlens-trial-{uuid.uuid4().hex}"
    spark.range(0, tasks, 1, tasks).write.parquet(trial)
    found = spark.read.schema("id long").parquet(trial).count()
    drop_folder(spark, trial)
    return found == tasks


def _all_reach(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and all executors share a folder of the local file system, as they do where one is mounted.

    Found out by writing to it: what an executor writes to a disk of its own is missing afterwards. Executors
    that join are tried when the next folder is asked for. A trial that fails means no.
    """
    try:
        executors = _executors(spark)
        reached = _reached.setdefault((spark.sparkContext.applicationId, folder), set())
        if not executors <= reached and _comes_back(spark, folder, 2 * len(executors)):
            reached |= executors
        return executors <= reached
    except Exception:
        return False


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates; a temporary one only in local mode.

    On a cluster the warehouse stands in for a folder that is not set or not shared.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        for folder in (shared, spark.conf.get("spark.sql.warehouse.dir", None)):
            if folder and (not _qualified(spark, folder).startswith("file:") or _all_reach(spark, folder.rstrip("/"))):
                return folder.rstrip("/")
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = tempfile.mkdtemp(prefix="spendlens-")
    return _temporary[app]


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one run, so runs never read each other's tables."""
    return f"{work_dir(spark)}/spendlens-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and continue from the files."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a run's folder from the shared store, when no frame made from it is used any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def month_of(day) -> F.Column:
    """Partition value of a day: 200111 for November 2001."""
    return F.year(day) * 100 + F.month(day)


def write_by_month(
    df: DataFrame, path: str, day: str = "date", mode: str = "errorifexists", figures: dict[str, Column] | None = None
) -> dict[str, Any]:
    """Write a dated table in one folder per month, each file sorted by day, and give ``figures`` over its rows.

    ``rebalance`` gathers a month and lets adaptive execution cut it by size, so a
    month with a third of all rows becomes many files and a small one a single
    file. A period then reads only its months, and the sort leaves narrow page
    statistics to skip the other days with.
    """
    gathered = df.withColumn(MONTH, month_of(F.col(day))).hint("rebalance", F.col(MONTH))

    def write(rows: DataFrame) -> None:
        rows.sortWithinPartitions(MONTH, day).write.mode(mode).partitionBy(MONTH).parquet(path)

    if not figures:
        write(gathered)
        return {}
    return write_observed(gathered, figures, write, lambda: read_by_month(df.sparkSession, path, df.schema))


def read_by_month(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a table of ``write_by_month``; ``schema`` is that of its data columns."""
    fields = [f for f in schema.fields if f.name != MONTH]
    full = type(schema)(fields).add(MONTH, "integer")
    return spark.read.schema(full).parquet(path)
