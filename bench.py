"""Headline ledger queries, timed warm: one JSON line with medians and p95 of the runs."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from ledgerloom import catalog

NAMES = ("summary_stats", "timeline_month", "transaction_page", "transaction_search", "balance_chain", "l3_best", "match_candidates", "aggregate_pairs", "refund_candidates")
RUNS = 3


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, worst = {}, {}
    for name in NAMES:
        runs = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        runs = sorted(runs[1:])
        took[name], worst[name] = round(median(runs), 3), round(runs[min(len(runs) - 1, int(len(runs) * 0.95))], 3)
    print(json.dumps({"metric": "headline ledger queries, warm median", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "p95": worst, "sf": sf}))


if __name__ == "__main__":
    main()
