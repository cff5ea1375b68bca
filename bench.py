"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_QUERIES comma-separated names, or "all" for every query on the log (default: the list below)
BENCH_SWEEP   comma-separated core counts: times the parse and session job alone on
              BENCH_LINES lines (default 1000000), made by repeating the events table
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from logweft.plans import catalog, views
from logweft.session import local_session

HEADLINE = [
    "parse_counters",
    "block_sessions",
    "event_matrix",
    "event_positions",
    "trace_label_join",
    "sliding_windows",
    "mask_parameters",
    "masked_dedup",
    "balanced_counts",
    "pack_batches",
    "sequence_features",
    "rotation_index",
    "explanations",
    "quality_gate",
    "validation_report",
    "corpus_union_dedup",
    "train_val_split",
    "severity_confidence",
    "running_stats",
    "recent_context",
    "stream_stats",
    "stream_sessions",
]


def spread_tables(spark, folder: str, files: int) -> str:
    """The tables with events in several files, as a real log has, so that one small
    file does not keep a scan on one core. Set-up, not timed."""
    out = tempfile.mkdtemp(prefix="bench-tables-")
    for name in os.listdir(folder):
        if name != "events.parquet":
            os.symlink(f"{folder}/{name}", f"{out}/{name}")
    spark.read.parquet(f"{folder}/events.parquet").repartition(files).write.parquet(f"{out}/events.parquet")
    return out


def sweep(folder: str, cores: list[int], lines: int) -> dict[str, float]:
    """Lines per second of raw lines to sessions at each number of cores."""
    found = {}
    for n in cores:
        spark = local_session(n, shuffle_partitions=max(n, 8))
        spark.sparkContext.setLogLevel("ERROR")
        events = spark.read.parquet(f"{folder}/events.parquet")
        have = events.count()
        copies = F.explode(F.sequence(F.lit(0), F.lit(-(-lines // have) - 1)))
        many = events.withColumn("again", copies).withColumn("event_id", F.col("event_id") + F.col("again") * have)
        many = many.withColumn("user_id", F.col("user_id") + F.col("again") * 1_000_000).limit(lines)
        out = tempfile.mkdtemp(prefix="bench-sweep-")
        many.drop("again").repartition(64).write.parquet(f"{out}/events.parquet")
        run = lambda: views.sessions(spark, out).write.format("noop").mode("overwrite").save()
        run()
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        found[str(n)] = round(lines / best)
        spark.stop()
    return found


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    if os.environ.get("BENCH_SWEEP"):
        cores = [int(n) for n in os.environ["BENCH_SWEEP"].split(",")]
        print(json.dumps({"lines_per_sec": sweep(folder, cores, int(os.environ.get("BENCH_LINES", 1_000_000)))}))
        return
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread_tables(spark, folder, cpus)
    run = lambda query: query(spark, tables).write.format("noop").mode("overwrite").save()
    queries = catalog.queries()
    names = sorted(queries) if names == ["all"] else names
    run(queries["parse_counters"])  # start the JVM's compilers before the clock runs
    seconds: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        run(queries[name])
        seconds[name] = round(time.perf_counter() - began, 3)
    lines = spark.read.parquet(f"{folder}/events.parquet").count()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
        "cpus": cpus,
        "log_lines": lines,
    }
    if "block_sessions" in seconds:
        result["sessionized_lines_per_sec"] = round(lines / seconds["block_sessions"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
