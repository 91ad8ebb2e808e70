"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully executed with a no-op sink (every row computed, nothing
collected to the driver): the session is warmed up by one query first, then the
median wall-clock time of three runs is taken.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterwise.plans.catalog import REGISTRY  # noqa: E402
from meterwise.session import build_session  # noqa: E402
from meterwise.sources.fixtures import Fixtures  # noqa: E402

HEADLINE = [
    ("W5", "balances"),
    ("A3", "daily_merged"),
    ("T2", "purchases_top10"),
    ("U-T1", "topup_scheduled"),
    ("P4", "admission_replay"),
    ("M4+M5", "verdicts"),
    ("T6", "rolling_24h"),
    ("T7", "running_balance"),
    ("A10", "dashboard"),
    ("ST5", "stream_balance"),
]


RUNS = 3


def run(fx: Fixtures, name: str) -> float:
    t = time.time()
    REGISTRY[name].build(fx).write.format("noop").mode("overwrite").save()
    return time.time() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    fx = Fixtures(spark, sf_dir)
    run(fx, "daily_totals")  # warm-up, not timed
    times = {}
    for op, name in HEADLINE:
        times[f"{op}:{name}"] = round(statistics.median(run(Fixtures(spark, sf_dir), name) for _ in range(RUNS)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
