"""The live job: growing log files to scored sessions, alerts and totals, as they close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweft import fixed_values as fv
from logweft.functions import render
from logweft.operators import explain as ex, samples as sm, scoring as sc, sessions as ss
from logweft.operators.templates import Template
from logweft.sources import tail
from logweft.streaming import keyed, live

HISTORY = "block_id string, first_ts timestamp, last_ts timestamp, n_events bigint, latency double, status string, explanation string"


def judged(
    closed: DataFrame,
    templates: list[Template],
    scorer: sc.Scorer | None = None,
    generator: Callable[[str], str] | None = None,
    **calls,
) -> DataFrame:
    """Closed sessions with ``status`` and ``explanation``: by the built-in rules, or by a
    scorer and a generator, which see each row once (``calls`` as in ``scoring.generate``)."""
    rows = closed.withColumn("sequence", ss.named(F.col("ords"), templates))
    rows = sm.prepare(rows.withColumn("content", sm.join_messages(ss.text_sequence(templates, F.col("sequence")))))
    asked = rows.drop("messages").withColumn("prompt", render.explainer_prompt(F.col("sequence"), F.col("latency")))
    if generator is None:
        told = ex.rule_explanation(sc.score(asked, scorer))
        text = F.col("explanation")
    else:
        if scorer is None:
            asked = sc.score(asked)
        told = sc.score_and_generate(asked, scorer, generator, **calls)
        text = sc.extracted(F.col("answer"))
    bad = sc.prediction(F.col("verdict")) == 1
    return told.select(
        "block_id", "first_ts", "last_ts", "n_events", "latency",
        F.when(bad, "Anomalous").otherwise("Normal").alias("status"),
        F.when(bad, text).otherwise(fv.NORMAL_REPLY).alias("explanation"),
    )


def write_history(out: str, judge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: sessions of a batch are judged and stored once, in
    ``history``; ``alerts`` and the snapshot ``totals`` come from what was stored. A batch
    that is run again replaces its own folders and snapshot."""
    store, alert = live.append_once(f"{out}/history"), live.append_once(f"{out}/alerts")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store(judge(batch), batch_id)
        history = spark.read.schema(HISTORY).parquet(f"{out}/history/batch={batch_id}")
        alert(live.alert_stream(history).select("block_id", "first_ts", "explanation"), batch_id)
        own = history.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "Anomalous").alias("anomalies"),
            F.count_if(F.col("status") == "Normal").alias("healthy"),
            F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency"),
        )
        before = live.snapshot_before(spark, f"{out}/totals", batch_id)
        if before is not None:
            own = own.unionByName(before).agg(*[F.sum(c).alias(c) for c in own.columns])
        live.write_snapshot(own, f"{out}/totals", batch_id)

    return write


def watch_log(
    spark: SparkSession,
    paths: str | list[str],
    templates: list[Template],
    out: str,
    gap_seconds: int = 1800,
    delay: str = "10 minutes",
    scorer: sc.Scorer | None = None,
    generator: Callable[[str], str] | None = None,
    every: str = "1 second",
    files_per_batch: int | None = None,
    **calls,
) -> StreamingQuery:
    """Follow growing log files: lines to occurrences, to sessions by inactivity gap, to
    verdicts, alerts and totals below ``out``. Runs until it is stopped, and goes on from
    its checkpoint when it is started again. :func:`finish` closes what is open."""
    lines = tail.tail_log(spark, paths, files_per_batch)
    marks = keyed.mark_stream(spark, f"{out}/marks")
    closed = keyed.gap_sessions(live.parse_stream(lines, templates), gap_seconds, delay, marks)
    judge = lambda rows: judged(rows, templates, scorer, generator, **calls)
    return live.start(closed, write_history(out, judge), f"{out}/state", every=every)


def finish(query: StreamingQuery, spark: SparkSession, out: str) -> None:
    """Process what there is, close all open sessions and stop."""
    try:
        query.processAllAvailable()
        keyed.request_flush(spark, f"{out}/marks")
        query.processAllAvailable()
    finally:
        query.stop()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Sessions so far: total, anomalies, healthy and the mean latency."""
    rows = live.snapshot(spark, f"{out}/totals")
    mean = F.coalesce(F.col("latency") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return rows.select("total", "anomalies", "healthy", mean.alias("avg_latency"))
