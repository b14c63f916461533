"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Every query is
run once to warm up and three times more; the median counts, from building the plan (plans kept by
the fixtures are dropped) to its last row. Making the message texts is part of most queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from pulsegrid.operators import alerts
from pulsegrid.plans import fixtures, registry
from pulsegrid.plans.registry import QUERIES

HEADLINE = [
    "decode_envelope",
    "parse_telemetry",
    "to_dlq",
    "eval_rule",
    "rules_as_of",
    "alert_transitions",
    "alert_history_with_commands",
    "active_alerts_asof",
    "dedupe_first_wins",
    "anti_join_existing",
    "payload_size_stats",
    "message_rate",
    "top_topics",
    "idle_topics",
    "counter_rate",
    "acl_audit",
]


def lineitem_alerts(spark, folder):
    return alerts.alert_transitions(fixtures.lineitem_evaluations(spark, folder))


def lineitem_active(spark, folder):
    return alerts.active_alerts_asof(fixtures.lineitem_evaluations(spark, folder))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: QUERIES[name] for name in HEADLINE}
    runs |= {"lineitem_alerts": lineitem_alerts, "lineitem_active": lineitem_active}
    kept_plans = [f for m in (fixtures, registry) for f in vars(m).values() if hasattr(f, "cache_clear")]
    times = {}
    for name, run in runs.items():
        taken = []
        for _ in range(4):
            for kept in kept_plans:
                kept.cache_clear()
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
