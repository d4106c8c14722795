"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewell import plans, registry  # noqa: E402, F401
from tidewell.session import session  # noqa: E402

HEADLINE = (
    "dedupe_latest_lineitem", "sla_by_nation_priority", "leg_percentiles", "trailing_load_1h", "quartile_drivers", "decile_lift", "pareto_share", "distinct_and_lists", "merge_upsert", "scd2_build",
    "change_feed", "conform_cdc", "event_funnel_strict", "event_funnel_optional", "asof_price", "asof_daily_rate", "validity_join", "order_enrichment", "interval_overlap", "money_identity", "knn_cosine", "hash_vector_tokens",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
