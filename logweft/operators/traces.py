"""Labelled traces: parsing with reasons, label join, event text, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweft import fixed_values as fv
from logweft.functions import text as tx
from logweft.operators.templates import Template

VALID_TYPES = [kind for kind, *_ in fv.ANOMALY_TYPES]


def checked_traces(raw: DataFrame, valid_types: list[int] = VALID_TYPES) -> DataFrame:
    """Failed traces with parsed fields and a ``skip_reason``, null when valid.

    One narrow pass; valid and skipped rows are two filters of the result.
    """
    features = tx.strip(F.coalesce("Features", F.lit("")))
    kind_text = tx.strip(F.coalesce("Type", F.lit("")))
    kind = F.when(kind_text.rlike("^[+-]?[0-9]+$"), kind_text.try_cast("int"))
    sequence = tx.bracket_list(features)
    parsed = raw.filter(tx.strip("Label") == "Fail").select(
        tx.strip("BlockId").alias("block_id"),
        kind.alias("anomaly_type"),
        sequence.alias("sequence"),
        tx.number_list(F.col("TimeInterval")).alias("time_interval"),
        tx.number(F.col("Latency")).alias("latency"),
        features.alias("_features"),
        kind_text.alias("_type"),
        *[c for c in raw.columns if c not in ("BlockId", "Label", "Type", "Features", "TimeInterval", "Latency")],
    )
    reason = (
        F.when(F.col("_features").isin("", "[]"), "empty features")
        .when(F.size("sequence") == 0, "empty after parsing")
        .when(F.col("anomaly_type").isNull(), F.concat(F.lit("unparseable type: "), F.col("_type")))
        .when(~F.col("anomaly_type").isin(valid_types), F.concat(F.lit("invalid type: "), F.col("anomaly_type")))
    )
    return parsed.withColumn("skip_reason", reason).drop("_features", "_type")


def valid_traces(raw: DataFrame, valid_types: list[int] = VALID_TYPES) -> DataFrame:
    return checked_traces(raw, valid_types).filter("skip_reason IS NULL").drop("skip_reason")


def skip_report(checked: DataFrame) -> DataFrame:
    return checked.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def first_skipped(checked: DataFrame, order: str, n: int = 10) -> DataFrame:
    return checked.filter("skip_reason IS NOT NULL").orderBy(order).limit(n).select("block_id", "skip_reason")


def anomaly_types(spark) -> DataFrame:
    return spark.createDataFrame(fv.ANOMALY_TYPES, "anomaly_type int, signal string, cause string, impact string")


def sampled_traces(raw: DataFrame) -> DataFrame:
    """Traces with a type, as the sampling path reads them: a decimal type is
    truncated, and event lists may be quoted."""
    kind = tx.number(F.col("Type"))
    rest = [c for c in raw.columns if c not in ("BlockId", "Label", "Type", "Features", "TimeInterval", "Latency")]
    return raw.filter(kind.isNotNull()).select(
        F.col("BlockId").alias("block_id"),
        kind.cast("int").alias("anomaly_type"),
        tx.sampled_list(F.col("Features")).alias("sequence"),
        tx.number(F.col("Latency")).alias("latency"),
        *rest,
    )


# -- labels ----------------------------------------------------------------


def label_join(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the block id with the notebook's event list and 0/1 label."""
    keyed = traces.withColumnsRenamed({"BlockId": "block_id"}).drop("Label")
    truth = labels.select(F.col("BlockId").alias("block_id"), F.col("Label").alias("truth"))
    joined = keyed.join(truth, "block_id")
    return joined.withColumns(
        {
            "events": tx.raw_bracket_list(F.col("Features")),
            "label": (F.col("truth") == "Anomaly").cast("int"),
        }
    )


def label_counts(joined: DataFrame, column: str = "truth") -> DataFrame:
    return joined.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


# -- text and windows ------------------------------------------------------


def events_text(events: Column, templates: list[Template]) -> Column:
    """Template texts joined by `` [SEP] ``; unknown events show as ``[UNK]``."""
    texts = {t.event_id: t.text for t in templates}
    lookup = F.create_map(*[F.lit(item) for pair in texts.items() for item in pair])
    named = F.transform(events, lambda e: F.coalesce(F.element_at(lookup, e), F.lit(fv.UNKNOWN_EVENT)))
    return F.array_join(named, fv.WINDOW_JOIN)


def window_starts(length: Column, window: int, stride: int) -> Column:
    """0, stride, 2*stride ... as long as a full window fits; always at least 0."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), length - window), F.lit(stride))


def windows(events: Column, window: int = 20, stride: int = 10) -> Column:
    return F.transform(
        window_starts(F.size(events), window, stride), lambda start: F.slice(events, start + 1, F.lit(window))
    )


def window_rows(traces: DataFrame, templates: list[Template], window: int = 20, stride: int = 10) -> DataFrame:
    """One row per window of ``events`` with its number and text. Narrow."""
    kept = [c for c in traces.columns if c != "events"]
    cut = traces.select(*kept, F.posexplode(windows(F.col("events"), window, stride)).alias("win_ix", "events"))
    return cut.withColumn("window_text", events_text(F.col("events"), templates))


def session_window_rows(
    session_rows: DataFrame, templates: list[Template], window: int = 20, stride: int = 10
) -> DataFrame:
    """Windows of sessions, also where a huge block is stored in parts.

    Each part borrows the first ``window - 1`` events of the following parts, so
    a window that crosses a boundary is cut once, by the part it starts in. The
    borrowed heads are short rows joined on (block, part). ``session_rows`` is
    read three times: pass a stored table.
    """
    whole = session_rows.filter("parts = 1").withColumn("_tail", F.array().cast("array<string>"))
    split = session_rows.filter("parts > 1")
    heads = split.filter("part > 0").select(
        "block_id", (F.col("part") - 1).alias("part"), F.slice("sequence", 1, window - 1).alias("_head")
    )
    joined = split.join(heads, ["block_id", "part"], "left").withColumn(
        "_tail", F.coalesce("_head", F.array().cast("array<string>"))
    )
    rows = whole.unionByName(joined.drop("_head"))
    start0 = (F.ceil(F.col("first_pos") / stride) * stride).cast("bigint")
    last = F.least(F.col("first_pos") + F.size("sequence") - 1, F.greatest(F.lit(0), F.col("n_events") - window))
    starts = F.when(start0 <= last, F.sequence(start0, last, F.lit(stride).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    cut = rows.select(
        "block_id", "first_pos", F.concat("sequence", "_tail").alias("_all"), F.explode(starts).alias("_start")
    )
    return cut.select(
        "block_id",
        (F.col("_start") / stride).cast("bigint").alias("win_ix"),
        F.slice("_all", (F.col("_start") - F.col("first_pos") + 1).cast("int"), F.lit(window)).alias("events"),
    ).withColumn("window_text", events_text(F.col("events"), templates))


def window_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("windows"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("anomalous_windows"),
    )


def nth_row(rows: DataFrame, order: str, n: int = 0) -> DataFrame:
    return rows.orderBy(order).offset(n).limit(1)


def profile(rows: DataFrame, label: str, order: str, distinct: int = 10) -> DataFrame:
    """Row and column count, the first row as JSON, and the first distinct labels.

    Labels are listed by first appearance, found with partial aggregation.
    """
    kinds = rows.groupBy(label).agg(F.min(order).alias("_at")).orderBy("_at").limit(distinct)
    listed = kinds.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", label))), lambda s: s[label]), ",")
    ).scalar()
    first = rows.orderBy(order).limit(1).select(F.to_json(F.struct(*rows.columns))).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(rows.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(rows.columns)).alias("columns"),
        first.alias("first_row"),
        listed.alias("labels"),
    )
