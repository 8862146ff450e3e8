"""Times the headline queries, the better of two runs each after a warm-up; prints one JSON line."""

import json
import os
import time

from tidemark.plans.registry import QUERIES
from tidemark.session import local_session, ship

HEADLINE = (
    "st4_ledger", "w1_trailing_median", "w5_compression", "w7_release_trigger", "sm2_classify", "a5_theme_heat", "sm4_member_states", "a1_signals",
    "sc3_setup_score", "sf1_sentiment", "x2_ticker_candidates", "g1_co_mentions", "tk8_top_neighbors", "j7_nearest_close", "a6_calibration",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("st4_ledger")  # start-up of the session and the workers
    run("w1_trailing_median")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1])}))


if __name__ == "__main__":
    main()
