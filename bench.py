"""Time the headline queries and print one JSON line.

Every query is run three times (BENCH_RUNS), the median counts, and is written in full to Spark's no-op sink. The data folder comes from BENCH_SF_DIR, the
number of threads from BENCH_CPUS; BENCH_QUERIES may name other queries, parted by commas.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featlake.plans import QUERIES  # noqa: E402
from featlake.session import build_session  # noqa: E402

HEADLINE = [
    "d1_category_profile", "d5_user_value_stats", "d8_user_diversity", "d11_user_periods", "d15_target_median",
    "d17_oof_mean", "d17_oof_median", "d18_target_smooth", "d19_count_encode", "e1_rank_avg", "e2_label_encode",
    "e4_gauss_rank", "x12_text_ratios", "i3_tfidf", "i7_token_sequences", "j2_ridge_oof", "j11_stack_matrix",
    "c9_snap_nearest", "k4_snap_and_mix", "d29_auc",
]


RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    times = {}
    for n in names:
        runs = []
        for _ in range(RUNS):
            t = time.time()
            QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        times[n] = round(statistics.median(runs), 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries, median of the runs", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
