"""Queries on labelled traces: reasons, labels, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft.operators import traces as tr
from logweft.plans import parsing, views as v
from logweft.plans.registry import Registry
from logweft.session import materialize

TRACES = Registry()

# Ground truth stand-in: the labels table, toxic read as anomalous. It covers some
# of the blocks, and some of its ids are no blocks.
LABELS_SQL = "labels_view AS (SELECT 'blk_' || doc_id AS BlockId, CASE WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS truth FROM labels)"


def label_view(spark: SparkSession, folder: str) -> DataFrame:
    return v.table(spark, folder, "labels").select(
        F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("BlockId"),
        F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal").alias("Label"),
    )


# SQL of the trace checks; numbers are kept as text until proven.
CHECKED_SQL = f"""{v.TRACES_SQL},
failed AS (
  SELECT BlockId AS block_id, trim(Type) AS kind, Features AS features, TimeInterval, Latency AS lat_text, line_id,
         list_filter(string_split(trim(Features, '[]'), ','), lambda e: e <> '') AS sequence
  FROM traces WHERE Label = 'Fail'),
checked AS (
  SELECT *, try_cast(CASE WHEN regexp_full_match(kind, '[+-]?[0-9]+') THEN kind END AS INTEGER) AS anomaly_type
  FROM failed),
reasoned AS (
  SELECT *, CASE WHEN features IN ('', '[]') THEN 'empty features'
                 WHEN len(sequence) = 0 THEN 'empty after parsing'
                 WHEN anomaly_type IS NULL THEN 'unparseable type: ' || kind
                 WHEN anomaly_type NOT IN (0, 1, 3, 4, 5, 7, 9, 16, 21, 31) THEN 'invalid type: ' || anomaly_type
            END AS skip_reason,
         CASE WHEN TimeInterval LIKE '%oops' THEN []::DOUBLE[]
              ELSE list_transform(string_split(trim(TimeInterval, '[]'), ', '), lambda g: g::DOUBLE) END AS time_interval,
         try_cast(nullif(lat_text, '') AS DOUBLE) AS latency
  FROM checked)"""
VALID_SQL = f"{CHECKED_SQL}, valid AS (SELECT * FROM reasoned WHERE skip_reason IS NULL)"


@TRACES.add(f"WITH {CHECKED_SQL} SELECT skip_reason, count(*) AS n FROM reasoned WHERE skip_reason IS NOT NULL GROUP BY 1")
def trace_skip_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return tr.skip_report(tr.checked_traces(v.traces(spark, folder)))


@TRACES.add(
    f"WITH {CHECKED_SQL} SELECT block_id, skip_reason FROM reasoned WHERE skip_reason IS NOT NULL ORDER BY line_id LIMIT 10"
)
def trace_first_skipped(spark: SparkSession, folder: str) -> DataFrame:
    return tr.first_skipped(tr.checked_traces(v.traces(spark, folder)), "line_id")


@TRACES.add(
    f"""WITH {VALID_SQL}
SELECT block_id, anomaly_type, array_to_string(sequence, ',') AS sequence, latency,
       len(time_interval) AS n_gaps, coalesce(list_sum(time_interval), 0) AS gap_sum FROM valid"""
)
def valid_traces(spark: SparkSession, folder: str) -> DataFrame:
    gap_sum = F.aggregate("time_interval", F.lit(0.0), lambda a, g: a + g)
    return tr.valid_traces(v.traces(spark, folder)).select(
        "block_id",
        "anomaly_type",
        F.array_join("sequence", ",").alias("sequence"),
        "latency",
        F.size("time_interval").cast("bigint").alias("n_gaps"),
        gap_sum.alias("gap_sum"),
    )


JOINED_SQL = f"""{v.TRACES_SQL}, {LABELS_SQL},
joined AS (
  SELECT BlockId AS block_id, truth, (truth = 'Anomaly')::INTEGER AS label,
         string_split(trim(Features, '[]'), ',') AS events
  FROM traces JOIN labels_view USING (BlockId))"""


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    return tr.label_join(v.traces(spark, folder), label_view(spark, folder))


@TRACES.add(
    f"WITH {JOINED_SQL} SELECT block_id, truth, label, array_to_string(list_transform(events, lambda e: coalesce({parsing._EVENT_TEXT}[e], '[UNK]')), ' [SEP] ') AS text FROM joined"
)
def trace_label_join(spark: SparkSession, folder: str) -> DataFrame:
    text = tr.events_text(F.col("events"), v.templates())
    return _joined(spark, folder).select("block_id", "truth", "label", text.alias("text"))


@TRACES.add(f"WITH {JOINED_SQL} SELECT truth, count(*) AS n FROM joined GROUP BY truth")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return tr.label_counts(_joined(spark, folder))


WINDOW_SQL = f"""{JOINED_SQL},
starts AS (SELECT *, unnest(range(0, greatest(0, len(events) - 4) + 1, 2)) AS start FROM joined),
cut AS (
  SELECT block_id, label, start // 2 AS win_ix, events[start + 1 : start + 4] AS events FROM starts)"""


@TRACES.add(
    f"WITH {WINDOW_SQL} SELECT block_id, win_ix, label, array_to_string(events, ',') AS events, array_to_string(list_transform(events, lambda e: coalesce({parsing._EVENT_TEXT}[e], '[UNK]')), ' [SEP] ') AS window_text FROM cut"
)
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.window_rows(_joined(spark, folder), v.templates(), window=4, stride=2)
    return rows.select("block_id", "win_ix", "label", F.array_join("events", ",").alias("events"), "window_text")


_TUNED_SQL = WINDOW_SQL.replace("len(events) - 4", "len(events) - 7").replace("+ 1, 2)", "+ 1, 3)").replace(
    "start // 2", "start // 3"
).replace("start + 4]", "start + 7]")


@TRACES.add(f"WITH {_TUNED_SQL} SELECT block_id, win_ix, array_to_string(events, ',') AS events FROM cut")
def tuned_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The same cut with other knobs: windows of seven events, three apart."""
    rows = tr.window_rows(_joined(spark, folder), v.templates(), window=7, stride=3)
    return rows.select("block_id", "win_ix", F.array_join("events", ",").alias("events"))


@TRACES.add(f"WITH {WINDOW_SQL} SELECT count(*) AS windows, sum(label)::BIGINT AS anomalous_windows FROM cut")
def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tr.window_counts(tr.window_rows(_joined(spark, folder), v.templates(), window=4, stride=2))


@TRACES.add(
    f"""WITH {v.SESSIONS_SQL},
starts AS (SELECT *, unnest(range(0, greatest(0, len(sequence) - 4) + 1, 2)) AS start FROM sessions)
SELECT block_id, start // 2 AS win_ix, array_to_string(sequence[start + 1 : start + 4], ',') AS events FROM starts"""
)
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows cut from sessions kept in parts of six events."""
    rows = materialize(v.session_parts(spark, folder, 6), "sessions")
    cut = tr.session_window_rows(rows, v.templates(), window=4, stride=2)
    return cut.select("block_id", "win_ix", F.array_join("events", ",").alias("events"))


@TRACES.add(
    f"WITH {WINDOW_SQL}, keyed AS (SELECT *, line_id FROM cut JOIN (SELECT BlockId AS block_id, line_id FROM traces) USING (block_id)) SELECT block_id, win_ix FROM keyed WHERE label = 1 ORDER BY line_id, win_ix LIMIT 1"
)
def first_anomalous_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.window_rows(_joined(spark, folder), v.templates(), window=4, stride=2).filter("label = 1")
    return rows.orderBy("line_id", "win_ix").limit(1).select("block_id", "win_ix")


@TRACES.add(
    f"""WITH {v.TRACES_SQL},
kinds AS (SELECT Label, min(line_id) AS seen FROM traces GROUP BY Label ORDER BY seen LIMIT 10)
SELECT (SELECT count(*) FROM traces) AS n_rows, 7 AS n_columns,
       (SELECT string_agg(Label, ',' ORDER BY seen) FROM kinds) AS labels,
       (SELECT BlockId FROM traces ORDER BY line_id LIMIT 1) AS first_block"""
)
def trace_profile(spark: SparkSession, folder: str) -> DataFrame:
    found = tr.profile(v.traces(spark, folder), "Label", "line_id")
    return found.select(
        "n_rows", "n_columns", "labels", F.get_json_object("first_row", "$.BlockId").alias("first_block")
    )
