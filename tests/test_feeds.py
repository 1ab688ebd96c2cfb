import gzip

import pytest

from spendlens.operators.aggregates import aggregate
from spendlens.operators.audit import audit
from spendlens.operators.fact import build_curated, curated_fact, write_curated
from spendlens.sources.feeds import EXPECTED, MALFORMED, csv_headers, feed_counts, feed_inventory, read_csv_by_name, read_feeds

from feeds import literal_feeds

HEADERS = {name: ",".join(columns) for name, columns in EXPECTED.items()}
ROWS = {
    "ad_performance_daily": "2026-06-05,C1,K1,1000,100,5,12.5,,INR\n 2026-06-06,C1,K1,1,1,1,1,2,INR\n",
    "campaigns": "C1,Search,Meta ,conversions,INR,10,2026-06-01,\n",
    "creatives": 'K1,C1,one,video,"Buy ""now"", save",2026-06-01\n',
    "fx_rates": "2026-06-05,INR,0.012\n",
}


def folder(path, skip=(), headers=HEADERS):
    for name in EXPECTED:
        if name not in skip:
            (path / f"{name}.csv").write_text(headers[name] + "\n" + ROWS[name])
    return str(path)


def test_everything_arrives_as_text(spark, tmp_path):
    feeds = read_feeds(spark, folder(tmp_path))
    for name, df in feeds.items():
        assert df.columns == [*EXPECTED[name], MALFORMED]
        assert {t for _, t in df.dtypes} == {"string"}
    perf = feeds["ad_performance_daily"].collect()
    assert perf[0]["revenue"] is None and perf[0]["spend"] == "12.5"
    assert perf[1]["date"] == " 2026-06-06"  # blanks are kept for the audit to see
    assert feeds["campaigns"].first()["channel"] == "Meta "
    assert feeds["campaigns"].first()["end_date"] is None
    assert feeds["creatives"].first()["headline"] == 'Buy "now", save'


def test_all_missing_feeds_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError) as error:
        read_feeds(spark, folder(tmp_path, skip=("campaigns", "fx_rates")))
    assert "campaigns.csv" in str(error.value) and "fx_rates.csv" in str(error.value)
    assert "creatives.csv" not in str(error.value)


def test_parquet_feeds_become_text(spark, tmp_path):
    for name, df in literal_feeds(spark).items():
        if name == "ad_performance_daily":
            df = df.withColumn("impressions", df.impressions.try_cast("double"))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    feeds = read_feeds(spark, str(tmp_path), "parquet")
    assert dict(feeds["ad_performance_daily"].dtypes)["impressions"] == "string"


def test_inventory_reports_drift(spark, tmp_path):
    headers = {
        **HEADERS,
        "campaigns": HEADERS["campaigns"].replace("objective", "goal"),
        "fx_rates": HEADERS["fx_rates"].replace("rate_to_usd", "rate_to_usd,source"),
    }
    (tmp_path / "x").mkdir()
    feeds = read_feeds(spark, folder(tmp_path / "x", headers=headers))
    rows = {r["feed"]: r for r in feed_inventory(feeds).collect()}
    assert rows["campaigns"]["severity"] == "BLOCKER"
    assert rows["campaigns"]["missing_columns"] == "objective"
    assert rows["campaigns"]["extra_columns"] == "goal"
    assert rows["fx_rates"]["severity"] == "INFO"
    assert rows["creatives"]["severity"] is None
    counts = {r["feed"]: r["n_rows"] for r in feed_counts(feeds).collect()}
    assert counts == {"ad_performance_daily": 2, "campaigns": 1, "creatives": 1, "fx_rates": 1}


def test_written_fact_reads_back_the_same(spark, tmp_path):
    fact = curated_fact(literal_feeds(spark))
    back = write_curated(fact, str(tmp_path / "fact"))
    assert back.drop("month").exceptAll(fact).count() == 0
    assert fact.exceptAll(back.drop("month")).count() == 0
    assert (tmp_path / "fact" / "month=202606").is_dir()


def test_from_csv_files_to_an_answer(spark, tmp_path):
    literal = literal_feeds(spark)
    for name, df in literal.items():
        df.write.option("header", True).option("escape", '"').csv(str(tmp_path / f"{name}.csv"))
    feeds = read_feeds(spark, str(tmp_path))
    fact = build_curated(spark, feeds).fact
    want = curated_fact(literal)
    assert fact.drop("month").exceptAll(want).count() == 0 and fact.count() == want.count()
    spend = {r["channel"]: r["spend_usd"] for r in aggregate(fact, "spend", "channel").collect()}
    assert spend == {"google_search": 79.0, "youtube": 20.0, "unattributed": 3.0, "meta": 1.0}


def test_files_of_one_feed_may_order_their_columns_differently(spark, tmp_path):
    path = folder(tmp_path, skip=("ad_performance_daily",))
    (tmp_path / "ad_performance_daily.csv").mkdir()
    first, second = list(EXPECTED["ad_performance_daily"]), list(EXPECTED["ad_performance_daily"])
    second[1], second[2] = second[2], second[1]
    rows = ["2026-06-05,C{0},K{0},1,1,1,1,1,INR", "2026-06-05,K{0},C{0},1,1,1,1,1,INR"]
    for i, names in enumerate((first, second)):
        lines = [",".join(names), *(rows[i].format(2 * n + i) for n in range(5))]
        (tmp_path / "ad_performance_daily.csv" / f"part{i}.csv").write_text("\n".join(lines) + "\n")
    third = [",".join(c for c in first if c != "revenue"), "2026-06-05,C99,K99,1,1,1,1,INR"]
    (tmp_path / "ad_performance_daily.csv" / "part2.csv").write_text("\ufeff" + "\n".join(third))
    got = {r["campaign_id"]: r for r in read_feeds(spark, path)["ad_performance_daily"].collect()}
    assert set(got) == {*(f"C{i}" for i in range(10)), "C99"}
    assert all(r["creative_id"] == "K" + c[1:] for c, r in got.items())
    assert got["C99"]["revenue"] is None and got["C99"]["date"] == "2026-06-05" and got["C99"][MALFORMED] is None


def test_rows_that_do_not_fit_are_kept_and_counted(spark, tmp_path):
    path = folder(tmp_path)
    with open(tmp_path / "fx_rates.csv", "a") as f:
        f.write("2026-06-06,INR,0.01,surplus\n2026-06-07,INR\n2026-06-08,INR,\n")
    feeds = read_feeds(spark, path)
    rows = {r["date"]: r for r in feeds["fx_rates"].collect()}
    assert rows["2026-06-06"][MALFORMED] == "2026-06-06,INR,0.01,surplus" and rows["2026-06-06"]["rate_to_usd"] == "0.01"
    assert rows["2026-06-07"][MALFORMED] == "2026-06-07,INR" and rows["2026-06-08"][MALFORMED] is None
    counts = {r["feed"]: r["malformed_rows"] for r in feed_inventory(feeds).collect()}
    assert counts == {"ad_performance_daily": 0, "campaigns": 0, "creatives": 0, "fx_rates": 2}
    found = {(r["check"], r["target"]): r["n_rows"] for r in audit(spark, feeds).collect()}
    assert found["malformed rows", "fx_rates"] == 2


def test_an_absent_feed_is_a_row_of_the_inventory(spark, tmp_path):
    feeds = read_feeds(spark, folder(tmp_path, skip=("creatives",)), allow_missing=True)
    rows = {r["feed"]: r for r in feed_inventory(feeds).collect()}
    assert rows["creatives"]["severity"] == "BLOCKER" and rows["creatives"]["n_rows"] == 0
    assert "headline" in rows["creatives"]["missing_columns"] and rows["campaigns"]["severity"] is None


def bytes_read(spark):
    """Bytes that this process has read from local files through Hadoop."""
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    return stats.getLong("bytesRead")


def test_headers_cost_no_job_and_no_scan(spark, tmp_path):
    names = ",".join(EXPECTED["ad_performance_daily"])
    (tmp_path / "big").mkdir()
    for i in range(2):
        with open(tmp_path / "big" / f"part{i}.csv", "w") as f:
            f.write(names + "\n" + "2026-06-05,C1,K1,1000,100,5,12.5,,INR\n" * 200_000)
    size = sum(f.stat().st_size for f in (tmp_path / "big").iterdir())
    spark.sparkContext.setJobGroup("headers", "headers")
    before = bytes_read(spark)
    headers = csv_headers(spark, str(tmp_path / "big"))
    read = bytes_read(spark) - before
    assert list(headers) == [names] and len(headers[names]) == 2
    assert read < 200_000 < size / 50
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert read_csv_by_name(spark, str(tmp_path / "big")).count() == 400_000


def test_headers_that_are_long_quoted_compressed_or_oddly_named(spark, tmp_path):
    long = [f"column_{i:05d}" for i in range(5000)]  # far beyond one buffer
    (tmp_path / "long.csv").write_text(",".join(long) + "\n" + ",".join("x" * 5000) + "\n")
    got = read_csv_by_name(spark, str(tmp_path / "long.csv"))
    assert got.columns == [*long, MALFORMED] and got.select(long[-1]).first()[0] == "x"
    (tmp_path / "quoted").mkdir()
    (tmp_path / "quoted" / "a file of 100%25.csv").write_bytes('\ufeff"a ""b""","c, d"\r\n1,2\r\n'.encode())
    with gzip.open(tmp_path / "quoted" / "b.csv.gz", "wt") as f:
        f.write('"c, d","a ""b"""\n4,3\n')
    (tmp_path / "quoted" / "empty.csv").write_text("")
    (tmp_path / "quoted" / "bare.csv").write_text("c, d")
    got = read_csv_by_name(spark, str(tmp_path / "quoted"))
    rows = sorted((r['a "b"'], r["c, d"]) for r in got.collect())
    assert rows == [("1", "2"), ("3", "4")]


def test_a_header_may_span_lines_where_rows_may(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,"b\nc"\n1,"2\n3"\n')
    got = read_csv_by_name(spark, str(tmp_path / "x.csv"), multiline=True)
    assert got.columns == ["a", "b\nc", MALFORMED]
    assert [tuple(r) for r in got.collect()] == [("1", "2\n3", None)]


def test_only_empty_files_are_an_empty_feed(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert read_csv_by_name(spark, str(tmp_path / "none")).count() == 0
