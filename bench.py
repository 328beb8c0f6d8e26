"""Time the headline queries and print one JSON line.

Each query runs twice into a no-op sink; the second run counts, so neither JVM
start-up nor code generation is measured. ``tier_build`` is temperatures,
percentiles and the stored tier table; the query split is made once before.
"""

from __future__ import annotations

import json
import os
import time

from thermocline.plans import bindings as b
from thermocline.plans.catalog import queries
from thermocline.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "cascade_topk", "cascade_staged", "cascade_sweep", "baseline_topk", "threshold_search", "ann_topk",
    "cosine_pairs", "doc_temperature", "similarity_profile", "threshold_report", "enrich_hits", "l2_normalize",
    "latency_stats_nearest_rank", "latency_stats_linear", "latency_compare", "storage_report",
    "access_stats", "top_accessed", "migration_pass", "migration_converge", "force_migration",
    "tier_upsert", "tier_table_roundtrip", "query_leakage", "embedding_cache_split",
    "stream_access_stats", "stream_migrate",
]


def _seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "thermocline-bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()

    def build() -> None:
        b.fresh_build(spark, SF_DIR)

    build()
    seconds = {"tier_build": _seconds(build)}
    catalog = queries()
    for name in HEADLINE:
        def run(query=catalog[name]) -> None:
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = _seconds(run)

    n_docs = b.doc_vectors(spark, SF_DIR).count()
    n_asked, n_work = b.held_out(spark, SF_DIR).count(), b.workload(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(SF_DIR).removeprefix("sf"), "cpus": int(CPUS),
        "cascade_queries_per_sec": round(n_asked / seconds["cascade_topk"], 1),
        "cascade_pairs_per_sec": round(n_asked * n_docs / seconds["cascade_topk"]),
        "temperature_pairs_per_sec": round(n_work * n_docs / seconds["doc_temperature"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
