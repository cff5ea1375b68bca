"""The live side: parsing, totals, alerts, recent lines and sessions on a stream.

State stays small per key: totals are a handful of numbers, a block holds its open
events (see ``keyed``), and what a batch hands to the next one is a snapshot of bounded
size and number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweft.functions import text as tx
from logweft.operators import lines as ln
from logweft.operators.templates import Template
from logweft.sources import logs

RECENT_LINES = 80


def live_lines(lines: DataFrame) -> DataFrame:
    """Level, arrival time and text of each line that is not blank."""
    text = tx.clean_line(F.col("value"))
    return lines.select(F.lit("INFO").alias("lvl"), F.current_timestamp().alias("ts"), text.alias("text")).filter(
        "text <> ''"
    )


def clock_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def parse_stream(lines: DataFrame, templates: list[Template]) -> DataFrame:
    """The batch parser, unchanged: it is stateless."""
    return ln.events(lines, templates)


def alert_stream(history: DataFrame) -> DataFrame:
    return history.filter(F.col("status") == "Anomalous")


def running_stats(history: DataFrame) -> DataFrame:
    """Totals so far; run in complete or update mode."""
    return history.groupBy().agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Anomalous").alias("anomalies"),
        F.count_if(F.col("status") == "Normal").alias("healthy"),
        F.avg("latency").alias("avg_latency"),
    )


def two_hour_counts(
    history: DataFrame, delay: str = "10 minutes", ts: str = "ts", marks: DataFrame | None = None
) -> DataFrame:
    """Anomalies per two-hour window of event time, each once it is closed. Rows beyond
    ``delay`` are dropped by Spark (:func:`keep_late` has them, :func:`add_counts` counts
    them). ``marks`` closes the last windows (see ``keyed.mark_stream``)."""
    rows = history.filter(F.col("status") == "Anomalous").select(F.col(ts).alias("ts"), F.lit(1).alias("one"))
    if marks is not None:
        rows = rows.unionByName(marks, allowMissingColumns=True)
    return (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", "2 hours").alias("w"))
        .agg(F.count("one").alias("anomalies"))
        .filter("anomalies > 0")
        .select(F.col("w.start").alias("window_start"), "anomalies")
    )


def rows_dropped_late(query: StreamingQuery) -> int:
    return sum(
        int(operator.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


# -- sinks -----------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def snapshot_ids(spark: SparkSession, path: str) -> list[int]:
    """Batches whose snapshot is complete, ascending."""
    system, where = _files(spark, path)
    if not system.exists(where):
        return []
    marked = system.globStatus(_path(spark, f"{path}/*/_SUCCESS")) or []
    return sorted(int(status.getPath().getParent().getName()) for status in marked)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def write_snapshot(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the state after a batch and remove those before its predecessor. Batch k reads
    snapshot k-1 and writes snapshot k, so a replay finds what it needs and writes the same."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/{batch_id}")
    system, _ = _files(spark, path)
    for old in snapshot_ids(spark, path):
        if old < batch_id - 1:
            system.delete(_path(spark, f"{path}/{old}"), True)


def snapshot_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state that a batch starts from: the newest of an earlier batch."""
    earlier = [i for i in snapshot_ids(spark, path) if i < batch_id]
    return spark.read.parquet(f"{path}/{earlier[-1]}") if earlier else None


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete state."""
    return spark.read.parquet(f"{path}/{snapshot_ids(spark, path)[-1]}")


def keep_recent(path: str, order: str, n: int = RECENT_LINES) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the newest ``n`` rows, as a snapshot per batch of which
    at most three exist."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.orderBy(F.desc(order)).limit(n)
        before = snapshot_before(batch.sparkSession, path, batch_id)
        if before is not None:
            rows = rows.unionByName(before).orderBy(F.desc(order)).limit(n)
        write_snapshot(rows, path, batch_id)

    return write


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer with one folder per batch: a replay overwrites its
    own folder, so every row is stored exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def store_occurrences(path: str, templates: list[Template]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that numbers a batch of raw lines, parses it and
    stores the occurrences, once per batch even when replayed."""
    append = append_once(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        append(ln.events(logs.number_lines(batch), templates), batch_id)

    return write


def once_per_key(stream: DataFrame, key: str = "block_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key, across batches and restarts: keys are state, so no batch
    reads what earlier ones stored. A key is forgotten ``delay`` after its time; with
    :func:`append_once` behind it, a replayed batch changes nothing."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def replace_table(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for complete mode: the result so far as a snapshot."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(batch, path, batch_id)

    return write


def keep_late(path: str, delay: str = "10 minutes", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the rows that came too late for a watermark of ``delay``:
    those at or before the latest time of earlier batches less the delay. Late rows are in
    ``path/late`` (a folder per batch), the latest time is a snapshot in ``path/high``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        high = snapshot_before(spark, f"{path}/high", batch_id)
        latest = batch.agg(F.max(ts).alias("high"))
        if high is None:
            late = batch.limit(0)
        else:
            bound = high.first()["high"]
            limit = F.lit(bound) - F.expr(f"INTERVAL {delay}")
            late = batch.filter(F.col(ts) <= limit) if bound is not None else batch.limit(0)
            latest = latest.unionByName(high).agg(F.max("high").alias("high"))
        append_once(f"{path}/late")(late, batch_id)
        write_snapshot(latest, f"{path}/high", batch_id)

    return write


def add_counts(path: str, keys: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of counts that late rows correct: ``keys`` turns a batch into
    rows of what is counted (such as :func:`anomaly_windows`), and the snapshot after a
    batch is the one before plus the batch's own counts. It has a row per distinct key,
    needs no watermark, and no window is ever closed to it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = keys(batch)
        names = rows.columns
        counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        before = snapshot_before(batch.sparkSession, path, batch_id)
        if before is not None:
            counted = counted.unionByName(before).groupBy(*names).agg(F.sum("n").alias("n"))
        write_snapshot(counted, path, batch_id)

    return write


def anomaly_windows(history: DataFrame, ts: str = "ts") -> DataFrame:
    """Start of the two-hour window of each anomaly."""
    anomalous = history.filter(F.col("status") == "Anomalous")
    return anomalous.select(F.window(ts, "2 hours")["start"].alias("window_start"))


_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def query_settings(spark: SparkSession) -> Iterator[None]:
    """What streaming queries need while they start; a running one keeps its own copy."""
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(
    stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process all input there is, then stop. The checkpoint makes it resumable."""
    writing = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
    with query_settings(stream.sparkSession):
        query = writing.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def caught_up(
    stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> Iterator[StreamingQuery]:
    """A running query that has processed all input there was, over as many batches as its
    source makes of it. ``processAllAvailable`` catches up again; it stops at the end."""
    query = start(stream, writer, checkpoint, mode, "0 seconds")
    try:
        query.processAllAvailable()
        yield query
    finally:
        query.stop()


def start(
    stream: DataFrame,
    writer: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str = "1 second",
) -> StreamingQuery:
    """Keep running, one batch per interval."""
    writing = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
    with query_settings(stream.sparkSession):
        return writing.trigger(processingTime=every).start()
