"""The metric queries off local mode, where intermediates go to a mounted folder."""

import datetime as dt

import pytest

from spendlens.catalog.queries import catalog
from spendlens.functions.metrics import GROUPINGS, METRICS

STAR = {
    "region": ("r_regionkey int, r_name string", [(1, "AMERICA"), (3, "EUROPE")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(2, "BRAZIL", 1), (7, "GERMANY", 3)]),
    "supplier": (
        "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
        [(k, f"Supplier {k}", (2, 7)[k % 2], 100.0 + k) for k in range(1, 13)],
    ),
    "part": (
        "p_partkey long, p_name string, p_type string, p_brand string",
        [(k, f"part {k}", "SMALL TIN", "Brand#1") for k in range(1, 6)],
    ),
    "lineitem": (
        "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double",
        [
            (k, n, dt.datetime(2001, 10, 3) + dt.timedelta(days=k % 20), k % 13, k % 7, 10.0 + n, 5.5 * k)
            for k in range(80, 160)
            for n in (1, 2, 3)
        ],
    ),
}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same tables in two folders, as written tables are kept by folder."""
    folders = [str(tmp_path_factory.mktemp("star")) for _ in range(2)]
    for name, (schema, rows) in STAR.items():
        for folder in folders:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folders


def test_metrics_are_those_of_local_mode(spark, both, monkeypatch):
    keys = [f"agg_{m}" if g == "none" else f"agg_{m}_by_{g}" for m in ("clicks", "conversions", "cpa", "cpc", "ctr") for g in GROUPINGS]
    assert {k.split("_")[1] for k in keys} <= set(METRICS)
    want = {k: catalog()[k](spark, both[0]).collect() for k in keys}
    assert want["agg_clicks"][0][0] > 0
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for k in keys:
        assert sorted(map(str, catalog()[k](spark, both[1]).collect())) == sorted(map(str, want[k])), k
