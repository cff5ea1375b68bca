"""Scores, totals and views that the dashboard shows, as columns and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft import fixed_values as fv
from logweft.functions import text as tx
from logweft.operators.ranking import running_totals


def confidence(status: Column, latency: Column, events: Column) -> Column:
    def less(hit: Column, points: int) -> Column:
        return F.when(hit, points).otherwise(0)

    score = (
        F.when(status == "Anomalous", 82).otherwise(95)
        - less(latency > 15, 8)
        - less(F.array_contains(events, "E22"), 5)
        - less(F.array_contains(events, "E11"), 3)
    )
    return F.greatest(F.lit(60), F.least(score, F.lit(99)))


def severity(status: Column, latency: Column) -> Column:
    chain = F.when(status == "Normal", "Low")
    for above, name in fv.SEVERITY_STEPS:
        chain = chain.when(latency > above, name)
    return chain.otherwise("Low")


def recommendations(status: Column, events: Column) -> Column:
    steps = [F.when(F.array_contains(events, event), F.lit(action)) for event, action in fv.EVENT_ACTIONS]
    return F.when(status == "Normal", F.array(*[F.lit(a) for a in fv.NORMAL_ACTIONS])).otherwise(
        F.array_compact(F.array(*steps, F.lit(fv.FINAL_ACTION)))
    )


def stats(history: DataFrame) -> DataFrame:
    """Totals; an unknown status counts in the total only."""
    return history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Anomalous").alias("anomalies"),
        F.count_if(F.col("status") == "Normal").alias("healthy"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"),
    )


def running_stats(
    history: DataFrame, cells: Sequence[Column], order: Sequence[str | Column], store: bool = False
) -> DataFrame:
    """The totals as they stood after each entry, without one global window."""
    flag = lambda status: F.when(F.col("status") == status, 1).otherwise(0).cast("bigint")
    rows = running_totals(
        history,
        [],
        cells,
        order,
        {
            "total": F.lit(1).cast("bigint"),
            "anomalies": flag("Anomalous"),
            "healthy": flag("Normal"),
            "_latency_sum": F.col("latency"),
        },
        store,
    )
    return rows.withColumn("avg_latency", F.col("_latency_sum") / F.col("total")).drop("_latency_sum")


def health_share(history: DataFrame) -> DataFrame:
    """Rows and percent of the healthy and anomalous entries (a handful of groups)."""
    counts = history.filter(F.col("status").isin("Normal", "Anomalous")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("percent", F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()) + 0.5))


def two_hour_anomalies(history: DataFrame, ts: str = "ts") -> DataFrame:
    """Anomalies by clock slot of two hours."""
    slot = (F.floor(F.hour(ts) / 2) * 2).cast("int")
    return (
        history.filter(F.col("status") == "Anomalous")
        .groupBy(slot.alias("slot"))
        .agg(F.count(F.lit(1)).alias("anomalies"))
    )


def search(history: DataFrame, query: str) -> DataFrame:
    wanted = F.lit(query.lower())
    return history.filter(F.contains(F.lower("block_id"), wanted) | F.contains(F.lower("status"), wanted))


def sort_history(history: DataFrame, key: str = "id", descending: bool = True) -> DataFrame:
    return history.orderBy(F.desc(key) if descending else F.asc(key))


def alerts(history: DataFrame, chars: int = 140) -> DataFrame:
    """Anomalous entries with a short text, in no order: ``newest_first`` is for the end."""
    short = F.concat(F.substring("explanation", 1, chars), F.lit("…"))
    return history.filter(F.col("status") == "Anomalous").select("id", "block_id", short.alias("preview"))


def dismiss(alert_rows: DataFrame, dismissed: DataFrame) -> DataFrame:
    return alert_rows.join(dismissed.select("id"), "id", "left_anti")


def newest_first(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.orderBy(F.desc("id"))


def recent_context(lines: DataFrame, keys: Sequence[str], order: str, n: int = 5) -> DataFrame:
    """The newest ``n`` texts per key joined, newest first. Spark keeps only ``n``
    rows per key and task before the shuffle (window group limit)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    top = lines.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return top.groupBy(*keys).agg(F.array_join(listed["text"], ", ").alias("context"))


def report_text(status: Column, score: Column, level: Column, explanation: Column) -> Column:
    return tx.fill(
        "Status: {s}\nConfidence: {c}%\nSeverity: {v}\nExplanation:\n{e}",
        s=status,
        c=score,
        v=level,
        e=explanation,
    )


def two_decimals(value: Column) -> Column:
    """Non-negative number with two decimals, rounded half up."""
    n = F.floor(value * 100 + 0.5)
    return F.concat((n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
