"""Writers. Parquet is the working format; CSV and JSON are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweft.functions import text as tx
from logweft.session import materialize


def write_sessions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_sessions_csv(rows: DataFrame, path: str) -> None:
    """Sessions with each list as ``['a', 'b']`` text."""
    lists = [name for name in ("sequence", "text_sequence") if name in rows.columns]
    flat = rows.withColumns({name: tx.python_list(F.col(name)) for name in lists})
    flat.select("block_id", *lists, "latency").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_contents_csv(rows: DataFrame, path: str) -> None:
    content = rows.select(F.col("content").alias("Content"), F.col("label").alias("Label"))
    content.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_explanations(rows: DataFrame, path: str, form: str = "json") -> None:
    if form == "csv":
        flat = rows.withColumn("sequence", tx.python_list(F.col("sequence")))
        flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        rows.write.mode("overwrite").format(form).save(path)


def append_by_verdict(rows: DataFrame, accepted_path: str, rejected_path: str) -> None:
    """Append gated chat records: accepted ones, and rejected ones with a reason.

    ``rows`` has ``messages, ok, reason, block_id, sequence``. A row without an
    answer is kept as block, sequence and reason only. Rows are stored before they are
    split, so what made them, such as calls to a model, runs once.
    """
    rows = materialize(rows.select("messages", "ok", "reason", "block_id", "sequence"), "verdicts")
    answered = F.col("messages").isNotNull()
    rows.filter("ok").select("messages").write.mode("append").json(accepted_path)
    rows.filter("NOT ok").select(
        F.when(~answered, F.col("block_id")).alias("block_id"),
        F.when(~answered, F.col("sequence")).alias("sequence"),
        F.when(~answered, F.col("reason")).alias("reason"),
        F.col("messages"),
        F.when(answered, F.col("reason")).alias("_reject_reason"),
    ).write.mode("append").json(rejected_path)
