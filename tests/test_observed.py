"""Figures that are observed while tables are written."""

import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from spendlens.operators.fact import build_curated, fact_figures, received_figures
from spendlens.operators.quality import accounting, quality_report, row_accounting
from spendlens.plans.observed import write_observed

from feeds import literal_feeds

ROOT = Path(__file__).resolve().parent.parent

# A job whose tasks each fail once, after their rows have been seen, in a session that allows it.
RETRIED = """
import json, sys
from pyspark import TaskContext
from pyspark.sql import functions as F
from spendlens.plans.observed import write_observed
from spendlens.session import local_session

spark = local_session("2,3", "retried", **{"spark.sql.shuffle.partitions": "2"})

def failing(batches):
    yield from batches
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("the first attempt is lost")

def write(rows):
    rows.mapInPandas(failing, rows.schema).write.parquet(sys.argv[1])

rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("copies"))
print("figures", json.dumps(write_observed(rows, {"rows": F.count("*"), "copies": F.sum("copies")}, write, lambda: spark.read.parquet(sys.argv[1]))))
"""


def test_a_retried_task_counts_once(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", RETRIED, str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, check=True
    )
    line = [x for x in done.stdout.splitlines() if "figures" in x][-1]
    assert json.loads(line.split("figures", 1)[1]) == {"rows": 100, "copies": 1000}
    assert "the first attempt is lost" in done.stderr


def test_figures_of_a_table_without_rows(spark, tmp_path):
    rows = spark.range(10).filter("id < 0").groupBy("id").agg(F.count("*").alias("copies"))
    path = str(tmp_path / "o")
    read = lambda: spark.read.schema(rows.schema).parquet(path)
    got = write_observed(rows, {"n": F.count("*"), "last": F.max("id")}, lambda r: r.write.parquet(path), read)
    assert got == {"n": 0, "last": None}


def test_report_is_that_of_the_tables_without_a_scan(spark):
    curated = build_curated(spark, literal_feeds(spark))
    want = row_accounting(curated.performance, curated.fact).collect()
    report = quality_report(curated)
    for df in (report, accounting(curated)):
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
    got = accounting(curated)
    assert [r.asDict() for r in got.select(*want[0].asDict()).collect()] == [r.asDict() for r in want]
    row = report.first().asDict()
    scanned = {
        **curated.performance.agg(*[c.alias(k) for k, c in received_figures().items()]).first().asDict(),
        **curated.fact.agg(*[c.alias(k) for k, c in fact_figures().items()]).first().asDict(),
    }
    assert {k: v for k, v in row.items() if k in scanned} == {k: v for k, v in scanned.items() if k in row}
    assert set(scanned) - set(row) == {"distinct_rows"}
