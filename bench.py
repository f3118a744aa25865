"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8). Tables that queries share are
released before each query, so every time includes the work from the files on.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from seismark.plans import catalog  # noqa: E402
from seismark.plans.q_compare import release  # noqa: E402
from seismark.session import build_session  # noqa: E402

ONLY = os.environ.get("BENCH_ONLY", "").split()
HEADLINE = [
    "c07_reversals", "c13_regret", "c16_compare_conditions", "c21_reweighted", "c24_view_deltas", "i01_boot_histogram", "i01_boot_poisson",
    "i02_pooled_ci", "i15_meta_all_families", "i19_interaction_lrt", "i20_interaction_wald", "h01_loso_summary", "h07_curve",
    "d02_rank_metrics", "d04_robust_rank", "d06_rank_threshold", "d10_onset_first_cross", "d14_lagcorr_graph", "d22_sigma_rank", "t01_resample",
    "t02_ffill_limit", "t05_window_case", "r05_rank_summary", "r07_score_sweep", "b03_overlay", "q02_check_case_sets", "q13_literal_audit", "s15_table_fingerprint",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "seismark-bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["c07_reversals"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in ONLY or HEADLINE:
        release(spark)
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
