"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

import workload.queries  # noqa: F401
from creditloom.session import build_session
from workload import registry

HEADLINE = [
    "scan_filter_project",
    "zero_fill_wide_join",
    "credit_limit_refine",
    "product_category",
    "semi_ever_in_region",
    "same_month_join",
    "full_outer_merge",
    "homeowner_inference",
    "nearest_site_distance",
    "prev_period_status",
    "rebuild_as_of",
    "stay_duration",
    "deferral_adjust",
    "spells",
    "arrears_buckets",
    "rollup_consumer",
    "region_panel",
    "region_eligibility",
    "descriptive_stats",
    "scm_placebo_pvalue",
    "scm_conf_set_uniform",
    "scm_weights",
    "pipe_consumer_panel",
    "pipe_tenure",
    "pipe_trade_clean",
    "pipe_time_adjust",
    "pipe_region_panel",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    df = registry.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    # One small query first, so that JVM start-up is not charged to the first headline query.
    run(spark, "freq_table", sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
