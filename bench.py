"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores. Every query runs
whole and its rows are consumed by the `noop` sink; one small run before warms the JVM up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from concord.plans import core, sources, streams

HEADLINE = {
    "search_page": core.search_page,
    "search_offers": core.search_offers,
    "rank_offers": core.rank_offers,
    "rank_docs": core.rank_docs,
    "merge_longest": core.merge_longest,
    "merge_values_mixed": core.merge_values_mixed,
    "sort_title": core.sort_title,
    "facets_top": core.facets_top,
    "limit_records": sources.limit_records,
    "source_status": sources.source_status,
    "resolve_settings": sources.resolve_settings,
    "multi_key_clusters": sources.multi_key_clusters,
    "stream_clusters": streams.stream_clusters,
}

#: The table whose rows a query goes through, where it isn't lineitem.
TABLE = {"rank_docs": "documents", "multi_key_clusters": "documents", "stream_clusters": "events", "resolve_settings": "supplier"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda query, data: query(spark, data).write.format("noop").mode("overwrite").save()
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        run(core.search_page, warm)
    seconds = {}
    only = sys.argv[1:]
    for name, query in HEADLINE.items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        run(query, folder)
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    size = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in {TABLE.get(n, "lineitem") for n in seconds}}
    found = re.search(r"sf([\d.]+)", folder)
    line = {
        "metric": "headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {n: round(size[TABLE.get(n, "lineitem")] / s) for n, s in seconds.items()},
        "sf": float(found.group(1)) if found else None,
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
