import datetime as dt

import pytest

from spendlens.operators import audit as a
from spendlens.operators.anomaly import last_day_ratios
from spendlens.operators.clean import dated_performance

from feeds import PERF, PERF_COLUMNS, literal_feeds

D = dt.date


@pytest.fixture(scope="module")
def feeds(spark):
    return {name: df.cache() for name, df in literal_feeds(spark).items()}


@pytest.fixture(scope="module")
def perf(feeds):
    return feeds["ad_performance_daily"]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_profile(perf, feeds):
    rows = by(a.profile(perf, "perf"), "column")
    assert set(rows) == set(PERF_COLUMNS)
    assert rows["revenue"]["nulls"] == 1 and rows["revenue"]["severity"] == "MEDIUM"
    assert rows["revenue"]["null_pct"] == round(100 / len(PERF), 2)
    assert rows["campaign_id"]["distinct_values"] == 5 and rows["campaign_id"]["severity"] is None
    assert rows["currency"]["sample"] == " usd"
    ends = by(a.profile(feeds["campaigns"], "campaigns"), "column")["end_date"]
    assert (ends["nulls"], ends["blanks"], ends["distinct_values"]) == (3, 3, 2)


def test_null_key_columns_are_grave(spark):
    df = spark.createDataFrame([(None, " "), ("C1", "x")], "campaign_id string, note string")
    rows = by(a.profile(df, "f"), "column")
    assert rows["campaign_id"]["severity"] == "HIGH" and rows["note"]["blanks"] == 1
    assert rows["note"]["severity"] is None


def test_duplicates_and_grain(spark, perf):
    assert tuple(a.dup_rows(perf, "p").first())[1:] == (1, 1)
    row = a.grain(perf, a.PERFORMANCE_GRAIN).collect()
    assert [(r["date"], r["n_rows"]) for r in row] == [("2026-06-06", 2)]
    assert tuple(a.grain_summary(perf, a.PERFORMANCE_GRAIN, "p").first())[1:] == (1, 2)
    sample = a.grain_sample(perf, a.PERFORMANCE_GRAIN).collect()
    assert len(sample) == 2 and sample[0] == sample[1]
    weighted = perf.groupBy(*perf.columns).count().withColumnRenamed("count", "copies")
    assert tuple(a.grain_summary(weighted, a.PERFORMANCE_GRAIN, "p", "copies").first())[1:] == (1, 2)


def test_grain_sample_is_cut_to_size(spark):
    df = spark.createDataFrame([(str(i % 20), str(i)) for i in range(100)], "k string, v string")
    got = a.grain_sample(df, ["k"], 12).collect()
    assert len(got) == 12 and {r["k"] for r in got} == {"0", "1", "10"}


def test_dates(perf):
    row = a.date_check(perf, "date", "p").first()
    # Read month first, 8 June becomes 6 August.
    assert (row["first_day"], row["last_day"]) == (D(2026, 6, 5), D(2026, 8, 6))
    assert (row["unparseable"], row["non_iso"], row["non_iso_values"]) == (1, 2, 2)
    assert set(by(a.date_offenders(perf, "date"), "text")) == {"08/06/2026", "June 8"}
    amb = a.ambiguous_dates(perf, "date").collect()
    assert [tuple(r) for r in amb] == [("08/06/2026", D(2026, 6, 8), D(2026, 8, 6), 1)]


def test_references(feeds):
    got = {(r["direction"], r["id"]): r["n_rows"] for r in a.referential(feeds).collect()}
    assert got == {
        ("performance without campaign", "C99"): 1,
        ("campaign without performance", "C5"): 1,
        ("performance without creative", "K3"): 1,
        ("creative without campaign", "C9"): 1,
    }


def test_currency(perf, feeds):
    got = by(a.attr_mismatch(perf, feeds["campaigns"], "campaign_id", "currency"), "campaign_id")
    # Compared as written: "usd" differs from "USD" here, unlike in the cleaned fact.
    assert {k: (r["row_value"], r["known_value"], r["n_rows"]) for k, r in got.items()} == {
        "C3": ("USD", "INR", 1), "C4": ("USD", "usd", 1)}
    assert by(a.value_counts(perf, "currency"), "currency")[" usd"]["n_rows"] == 1
    pairs = {tuple(r) for r in a.missing_pairs(perf, feeds["fx_rates"], a.RATE_GRAIN).collect()}
    assert pairs == {("2026-06-06", "INR"), ("08/06/2026", "INR"), ("June 8", "INR"), ("2026-06-08", " usd")}


def test_rates(spark, feeds):
    gaps = by(a.feed_gaps(feeds["fx_rates"]), "currency")
    assert (gaps["INR"]["n_rows"], gaps["INR"]["calendar_gaps"]) == (3, 2)
    assert (gaps["INR"]["min_rate"], gaps["INR"]["max_rate"]) == (0.010, 0.012)
    assert a.base_rate_check(feeds["fx_rates"]).first()["off_rows"] == 0
    off = spark.createDataFrame([("2026-06-05", "USD", "1.01"), ("2026-06-06", "USD", "x")],
                                "date string, currency string, rate_to_usd string")
    assert a.base_rate_check(off).first()["off_rows"] == 2
    assert tuple(a.dup_keys(feeds["fx_rates"], a.RATE_GRAIN).first()) == (1, 1)


def test_stray_dates_are_set_aside_before_gaps_are_counted(spark):
    days = [D(2026, 6, 8) + dt.timedelta(days=i) for i in range(89) if i not in (41, 42)]
    rows = [(d.isoformat(), "C1", "K", "1", "1", "1", "1", "1", "INR") for d in days]
    rows += [("11/07/2026", "C1", "K", "1", "1", "1", "1", "1", "INR")] * 2
    perf = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PERF_COLUMNS))
    volume = a.daily_volume(perf)
    strays = a.stray_dates(volume).collect()
    assert [tuple(r) for r in strays] == [(D(2026, 11, 7), 2)]
    gaps = sorted(r["date"] for r in a.audit_missing_days(volume).collect())
    assert gaps == [D(2026, 7, 19), D(2026, 7, 20)]


def test_daily_volume_from_rows_and_from_counts(spark, perf):
    copies = perf.groupBy(*perf.columns).count().withColumnRenamed("count", "copies")
    direct = a.daily_volume(perf)
    assert direct.exceptAll(a.daily_volume(a.summarise(copies), "n_raw")).count() == 0
    june = by(direct, "date")
    assert june[D(2026, 6, 6)]["n_rows"] == 2 and june[D(2026, 6, 6)]["spend"] == 2000.0
    assert june[D(2026, 6, 8)]["campaigns"] == 4
    assert D(2026, 8, 6) in june  # the stray


def test_values(perf):
    rules = {r["rule"]: r["n_rows"] for r in a.impossible_values(perf).collect()}
    assert rules == {
        "negative spend": 1, "negative revenue": 0, "negative conversions": 0,
        "clicks > impressions": 1, "conversions > clicks": 0, "spend > 0 with 0 impressions": 0,
        "revenue > 0 with 0 conversions": 3, "non-integer impressions": 0,
    }
    assert {r["column"]: r["zero_rows"] for r in a.zero_denoms(perf).collect()} == {
        "spend": 0, "impressions": 0, "conversions": 4}
    bad = by(a.non_numeric(perf), "column")
    assert (bad["clicks"]["n_bad"], bad["clicks"]["examples"]) == (1, "abc")
    assert (bad["spend"]["n_bad"], bad["spend"]["examples"]) == (1, "n/a")
    assert bad["revenue"]["n_bad"] == 0 and len(bad) == 5


def test_numeric_summary_matches_numpy(perf):
    import numpy as np

    got = by(a.numeric_summary(perf), "column")
    for column in ("impressions", "revenue"):
        i = PERF_COLUMNS.index(column)
        values = np.array([float(r[i]) for r in PERF if r[i] is not None])
        r = got[column]
        assert r["n"] == len(values) and r["mean"] == pytest.approx(values.mean(), abs=1e-4)
        assert r["std"] == pytest.approx(values.std(ddof=1), abs=1e-4)
        assert [r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == pytest.approx(
            list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])), abs=1e-4)


def test_vocabulary(feeds):
    rows = by(a.vocabulary(feeds), "feed", "column", "value")
    assert rows["campaigns", "channel", "google_search"]["is_expected"]
    assert not rows["campaigns", "channel", "Meta "]["is_expected"]
    assert rows["campaigns", "channel", "Meta "]["has_stray_blanks"]
    assert rows["creatives", "format", "image "]["is_expected"] is None
    own = by(a.vocabulary(feeds, {"format": ["video"]}), "feed", "column", "value")
    assert own["creatives", "format", "video"]["is_expected"]
    assert not own["creatives", "format", "image"]["is_expected"]


def test_campaign_windows_and_budgets(perf, feeds):
    row = a.window_check(perf, feeds["campaigns"]).first()
    assert (row["campaigns"], row["still_running"], row["reversed_windows"]) == (5, 3, 1)
    assert (row["first_start"], row["last_start"]) == (D(2026, 6, 1), D(2026, 6, 20))
    assert (row["rows_before_start"], row["rows_after_end"]) == (0, 0)
    late = perf.unionByName(perf.sparkSession.createDataFrame(
        [("2026-06-12", "C3", "K1", "1", "1", "1", "1", "1", "INR"),
         ("2026-05-31", "C1", "K1", "1", "1", "1", "1", "1", "INR")], perf.schema))
    row = a.window_check(late, feeds["campaigns"]).first()
    assert (row["rows_before_start"], row["rows_after_end"]) == (1, 1)
    assert tuple(a.budget_check(feeds["campaigns"]).first()) == (1, 0.0, 1500.0, 1)


def test_rollup_finds_every_planted_defect(spark, feeds):
    found = a.audit(spark, feeds).collect()
    rows = {(r["check"], r["target"]): r for r in found}
    counts = {k: r["n_rows"] for k, r in rows.items()}
    perf = "ad_performance_daily"
    assert counts["duplicate rows", perf] == 1
    assert counts["grain", perf] == 2 and counts["grain", "fx_rates"] == 2
    assert counts["nulls", f"{perf}.revenue"] == 1
    assert counts["unparseable date", f"{perf}.date"] == 1
    assert counts["non-ISO date", f"{perf}.date"] == 2
    assert counts["orphan campaigns", perf] == 1 and counts["orphan creatives", perf] == 1
    assert counts["unused campaigns", "campaigns"] == 1
    assert counts["unknown campaigns", "creatives"] == 1
    assert counts["currency mismatch", perf] == 2
    assert counts["missing rates", "fx_rates"] == 4
    assert counts["rate gaps", "fx_rates.INR"] == 2
    assert counts["duplicate rate keys", "fx_rates"] == 1
    assert counts["reversed window", "campaigns"] == 1
    assert counts["budget", "campaigns.daily_budget"] == 1
    assert counts["unexpected values", "campaigns.channel"] == 3
    assert counts["stray blanks", "creatives.format"] == 1
    assert counts["non-numeric", f"{perf}.spend"] == 1
    assert counts["zero denominator", f"{perf}.conversions"] == 4
    assert ("base rate", "fx_rates.rate_to_usd") not in counts
    order = [a.SEVERITIES.index(r["severity"]) for r in found]
    assert order == sorted(order) and all(r["n_rows"] > 0 for r in found)
    by_severity = {r["severity"]: r["n_findings"] for r in a.severity_counts(a.audit(spark, feeds)).collect()}
    assert sum(by_severity.values()) == len(found)


def test_rollup_reports_column_drift(spark, feeds):
    extra = {**feeds, "campaigns": feeds["campaigns"].selectExpr("*", "'x' as owner")}
    found = {(r["check"], r["target"]): r for r in a.audit(spark, extra).collect()}
    assert found["extra columns", "campaigns"]["detail"] == "owner"
    assert ("duplicate rows", "ad_performance_daily") in found
    lacking = {**feeds, "fx_rates": feeds["fx_rates"].drop("currency")}
    rest = {(r["check"], r["target"]): r for r in a.audit(spark, lacking).collect()}
    assert rest["missing columns", "fx_rates"]["severity"] == "BLOCKER"
    assert rest["missing columns", "fx_rates"]["detail"] == "currency"
    # Only what needs the column is left out.
    whole = {(r["check"], r["target"]) for r in a.audit(spark, feeds).collect()}
    gone = whole - set(rest)
    assert gone and all("fx_rates" in target for _, target in gone)
    assert ("duplicate rows", "fx_rates") in rest and ("orphan campaigns", "ad_performance_daily") in rest


@pytest.mark.parametrize("feed", ["ad_performance_daily", "campaigns", "creatives", "fx_rates"])
def test_rollup_of_a_delivery_that_lacks_a_feed(spark, feeds, feed):
    rest = {k: v for k, v in feeds.items() if k != feed}
    found = {(r["check"], r["target"]): r["severity"] for r in a.audit(spark, rest).collect()}
    assert found["missing feed", feed] == "BLOCKER" and len(found) > 3
    assert not any(target.startswith(feed) for check, target in found if check != "missing feed")


def test_rollup_of_nothing(spark):
    assert {r["check"] for r in a.audit(spark, {}).collect()} == {"missing feed"}


@pytest.mark.parametrize("column", PERF_COLUMNS)
def test_rollup_without_any_one_column(spark, feeds, column):
    lacking = {**feeds, "ad_performance_daily": feeds["ad_performance_daily"].drop(column)}
    found = {(r["check"], r["target"]) for r in a.audit(spark, lacking).collect()}
    assert ("missing columns", "ad_performance_daily") in found and ("duplicate rate keys", "fx_rates") in found


def test_findings_state_ids_and_rows(spark, feeds):
    found = {r["check"]: r["detail"] for r in a.audit(spark, feeds).collect()}
    assert found["orphan campaigns"].endswith("1 ids") and found["currency mismatch"].endswith("2 ids")


def test_counts_of_the_cleaning_layer_serve_the_audit(spark, feeds):
    copies = dated_performance(feeds["ad_performance_daily"])
    own, given = a.audit(spark, feeds), a.audit(spark, feeds, copies=copies)
    assert own.exceptAll(given).count() == 0 and own.count() == given.count()


def test_not_a_number_and_infinity_are_no_numbers(spark):
    rows = [("2026-06-05", "C1", "K", t, "1", "1", t, "1", "INR") for t in ("nan", "NaN", "inf", "-Infinity", "1e400", "7")]
    perf = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PERF_COLUMNS))
    bad = by(a.non_numeric(perf, examples=9), "column")
    assert bad["spend"]["n_bad"] == 5 and "nan" in bad["spend"]["examples"]
    assert by(a.numeric_summary(perf), "column")["spend"]["mean"] == 7.0


def test_short_feeds_are_not_judged_by_their_last_day(spark):
    def volume(days):
        return spark.createDataFrame(
            [(D(2026, 6, 1) + dt.timedelta(days=i), 1 if i == days - 1 else 100, 1, 1, 1, 1.0) for i in range(days)],
            "date date, n_rows long, campaigns long, impressions long, conversions long, spend double")

    few, enough = by(last_day_ratios(volume(14)), "measure"), by(last_day_ratios(volume(15)), "measure")
    assert few["n_rows"]["ratio"] is None and not few["n_rows"]["looks_partial"]
    assert enough["n_rows"]["ratio"] == 0.01 and enough["n_rows"]["looks_partial"]
    assert by(last_day_ratios(volume(3), min_days=3), "measure")["n_rows"]["looks_partial"]


def test_profile_keeps_whole_values_and_can_approximate(spark):
    df = spark.createDataFrame([("x" * 100, str(i % 300)) for i in range(3000)], "a string, b string")
    exact, rough = by(a.profile(df, "f"), "column"), by(a.profile(df, "f", approx=True), "column")
    assert exact["a"]["sample"] == "x" * 100 and exact["b"]["distinct_values"] == 300
    assert abs(rough["b"]["distinct_values"] - 300) < 30
