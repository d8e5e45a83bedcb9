"""Headline benchmark: runs the main moderation queries on one scale factor.

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully executed (noop sink) once to warm up, then timed
BENCH_REPEATS times (default 3, median reported, plan construction
included).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tidewatch.plans import catalog  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = ["blocklist_match", "match_all_terms", "regex_match", "evaluate_messages",
            "abuse_strikes", "abuse_strikes_replay", "action_notifications", "report_status",
            "apply_edits", "list_as_of", "confusion_matrix", "read_labeled_posts",
            "large_blocklist_match", "score_texts", "format_report", "search_report"]


# rows/s: input rows of the query's main table over its time
RATES = {"blocklist_match": "documents", "evaluate_messages": "documents", "abuse_strikes": "orders",
         "abuse_strikes_replay": "orders", "confusion_matrix": "labels"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("tidewatch-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "4g")})
    times, build = {}, {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(REPEATS):           # median of REPEATS timed runs
            t0 = time.perf_counter()
            df = fn(spark, sf_dir)         # plan construction (driver side)
            t1 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            t2 = time.perf_counter()
            runs.append((t2 - t0, t1 - t0))
        middle = sorted(runs)[len(runs) // 2]
        times[name] = round(middle[0], 3)
        build[name] = round(middle[1], 3)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "orders", "labels")}
    rates = {q: round(tables[t] / times[q], 1) for q, t in RATES.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "plan_build_sec": build,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "rows_per_sec": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
