"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to completion with a no-op sink (``write.format("noop")``), so the
timing covers the full plan without collecting rows to the driver. Every headline query is
first run once on the smallest data set (not timed) so JVM/JIT and Python worker start-up are
not charged to the first query measured. The figure of a query is the median of BENCH_RUNS rounds
(3); a round is only begun while BENCH_SECONDS (420) are not used up, and at least one is run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rateflow.plans.queries import QUERIES  # noqa: E402
from rateflow.session import local_session  # noqa: E402

HEADLINE = [
    "extract_rates",
    "normalised_rates",
    "html_reply",
    "mime_project",
    "mail_rates",
    "structured_project",
    "all_or_nothing",
    "thread_cut",
    "csv_roundtrip",
    "stream_rates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="rateflow-bench")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:  # JIT and Python worker start-up for every code path, not timed
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    rounds: dict[str, list[float]] = {name: [] for name in HEADLINE}
    began = time.perf_counter()
    for done in range(int(os.environ.get("BENCH_RUNS", "3"))):
        used = time.perf_counter() - began
        if done and used + used / done > float(os.environ.get("BENCH_SECONDS", "420")):
            break
        for name in HEADLINE:
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            rounds[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(t), 3) for name, t in rounds.items()}
    n_orders = spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_headline_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "messages": n_orders,
                "extract_rates_msgs_per_sec": round(n_orders / times["extract_rates"], 1),
                "cpus": cpus,
                "runs": len(rounds[HEADLINE[0]]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
