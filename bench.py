"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from imagora.plans import registry
from imagora.session import local_session, ship_package

HEADLINE = (
    "parse_generated embed_text bm25_index bm25_topk hybrid_topk fused_topk_text gate_s2_text "
    "dense_topk centroid_single centroid_fields hypo_topk_skill field_paths fused_topk two_stage_topk "
    "recall_at_k k_matrix metric_grid micro_macro route_domain route_l2a route_l2b3 gate_calibrate gate_apply "
    "pack_top50 fleet_metrics leaderboard k_curve bootstrap_paired bootstrap_arms bootstrap_hier "
    "paired_report bootstrap_multinomial scan_run generate_missing text_totals table_digest bm25_quality"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    ship_package(spark)
    # start the JVM's and the Python workers' own machinery before timing
    spark.range(1000).repartition(8).mapInPandas(lambda it: it, "id long").selectExpr("sum(id)").collect()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
