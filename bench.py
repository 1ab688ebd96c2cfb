"""Benchmark: seconds per headline query, one JSON line on stdout.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query runs
once to warm the engine and is then timed on a second, newly planned run. The
cleaning layer is timed as a query of its own, into a fresh folder each time.
"""

from __future__ import annotations

import json
import os
import time

from spendlens.catalog.queries import catalog, workspace
from spendlens.operators.fact import build_curated
from spendlens.session import local_session

HEADLINE = [
    "spend_by_channel_8_weeks", "rank_revenue_by_campaign", "rank_flip", "anomaly_conversions",
    "last_day_check", "pause_scorecard", "scorecard", "kpis", "campaign_roas", "daily_spend",
    "fx_impact", "agg_roas_by_campaign", "agg_cpc_by_creative", "spend_share", "missing_days",
    "quality_report", "parts_sum_to_total", "dup_rows", "grain_violations", "profile",
    "numeric_summary", "impossible_values", "referential", "currency_mismatch", "daily_volume",
    "audit_findings",
]


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog()
    space = workspace(spark, folder)

    seconds = {}
    for _ in range(2):
        seconds["curated_build"] = timed(lambda: build_curated(spark, space.feeds))
    for name in HEADLINE:
        for _ in range(2):
            seconds[name] = timed(
                lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            )
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").split("/sf")[-1],
                "fact_rows": space.fact.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
