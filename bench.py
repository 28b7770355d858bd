"""Time the headline queries: `BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py` prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from dealgrid.plans import catalog
from dealgrid.session import clear_scratch, local_session

HEADLINE = (
    "fx_convert", "forecast_headline", "owner_breakdown", "goal_attainment", "pacing", "book_movement", "stage_conversion",
    "engagement_trend", "deal_ranking", "refresh_merge", "verify_sync", "reconcile_three_way", "upsert_by_key", "latest_record",
    "close_date_pushes", "stage_medians", "flag_stalled", "threading_flags", "risk_flags", "loss_clusters",
    "renewal_risk_flags", "renewal_coverage", "link_renewal_opp", "conflict_check", "partner_performance", "quote_guardrails",
    "quote_approval", "quote_versions", "campaign_funnel", "lead_triage", "match_leads", "competitor_record", "watchlist_sweep",
    "dedup_signals", "signal_account_link", "signal_fit", "meeting_prep", "task_verification", "asset_lookup", "stream_task_caps",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = local_session(cpus, "dealgrid-bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
