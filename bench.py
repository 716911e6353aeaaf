"""Headline queries at ``BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "W1_form", "W6_h2h", "W10_compute_features", "J11_rank_carry_forward", "P15_combine_ranks", "W13_forfeit_features",
    "P1_explode_maps", "P10_exclusion_audit", "A32_forfeit_team_mode", "W18_pool_before",
    "M8_veto_path_distribution", "J3_latest_snapshot", "A15_edge_stats", "A12_adaptive_calibration_bins", "A8_binary_metrics",
    "A24_odds_summary", "E1_temporal_split", "L1_settle_pending",
]


def main() -> None:
    from rivalry.plans import load_all
    from rivalry.plans.registry import QUERIES, Tables
    from rivalry.session import local_session

    load_all()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = [a for a in sys.argv[1:]] or HEADLINE
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    Tables(spark, folder).read("orders").count()  # start-up is not part of a query
    times: dict[str, float] = {}
    for name in wanted:
        start = time.time()
        df = QUERIES[name](spark, folder)
        # every column is computed, nothing is collected
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    map_rows = Tables(spark, folder).view("maps").count()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "cores": int(os.environ.get("BENCH_CPUS", "8")), "map_rows": map_rows}))


if __name__ == "__main__":
    main()
