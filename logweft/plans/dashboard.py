"""Queries on scored sessions: verdicts, dashboard numbers and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv
from logweft.functions import render
from logweft.operators import dashboard as db, samples as sm, scoring as sc
from logweft.operators.ranking import line_cells
from logweft.plans import views as v
from logweft.plans.explaining import _in, _pairs
from logweft.plans.registry import Registry

DASHBOARD = Registry()

VERDICT_SQL = f"""{v.SESSIONS_SQL},
judged AS (
  SELECT *, CASE WHEN len(list_filter(sequence, lambda e: {_in(fv.FAILURE_EVENTS, "e")})) > 0
                   OR (list_contains(sequence, 'E22') AND NOT list_contains(sequence, 'E26'))
                   OR {_pairs("E26", "E23")} > 0 THEN 'anomalous' ELSE 'normal' END AS verdict
  FROM sessions)"""

# Scored requests: a few have no usable verdict, and latency is in a range that
# reaches every severity.
HISTORY_SQL = f"""{VERDICT_SQL},
history AS (
  SELECT first_line AS id, block_id, sequence AS events, latency % 26 AS latency, first_ts AS ts, verdict,
         CASE WHEN n % 17 = 0 THEN 'Unknown' WHEN verdict = 'anomalous' THEN 'Anomalous' ELSE 'Normal' END AS status,
         'events ' || array_to_string(sequence, ' then ') AS explanation
  FROM judged)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = sc.score(v.sessions(spark, folder))
    return rows.withColumn("prediction", sc.prediction(F.col("verdict")))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    n = F.substring("block_id", 5, 20).cast("bigint")
    return _scored(spark, folder).select(
        F.col("first_seen.line_id").alias("id"),
        "block_id",
        F.col("sequence").alias("events"),
        (F.col("latency") % 26).alias("latency"),
        F.col("first_ts").alias("ts"),
        F.when(n % 17 == 0, "Unknown").when(F.col("prediction") == 1, "Anomalous").otherwise("Normal").alias("status"),
        F.concat(F.lit("events "), F.array_join("sequence", " then ")).alias("explanation"),
    )


@DASHBOARD.add(
    f"WITH {VERDICT_SQL} SELECT block_id, verdict, (verdict = 'anomalous')::INTEGER AS prediction FROM judged"
)
def verdict_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("block_id", "verdict", "prediction")


@DASHBOARD.add(f"WITH {VERDICT_SQL} SELECT block_id, verdict FROM judged WHERE verdict = 'anomalous' ORDER BY first_line LIMIT 10")
def first_to_explain(spark: SparkSession, folder: str) -> DataFrame:
    flagged = sc.anomalies(_scored(spark, folder)).withColumn("line_id", F.col("first_seen.line_id"))
    return sc.first_to_explain(flagged, "line_id", 10).select("block_id", "verdict")


def _hook(texts: list[str]) -> list[str]:
    return ["The sequence is ANOMALOUS." if "Exception" in t else "normal" for t in texts]


@DASHBOARD.add(
    f"WITH {v.LINES_SQL} SELECT line_id, contains(value, 'Exception')::INTEGER AS prediction FROM log_lines WHERE value <> ''"
)
def scorer_hook(spark: SparkSession, folder: str) -> DataFrame:
    """A caller's own scorer, fed Arrow batches of texts on the executors."""
    lines = v.log_lines(spark, folder).filter("value <> ''").select("line_id", F.col("value").alias("content"))
    return sc.score(lines, _hook).select("line_id", sc.prediction(F.col("verdict")).alias("prediction"))


_REPLIES_SQL = f"""{v.LINES_SQL},
replies AS (
  SELECT line_id, CASE line_id % 6
    WHEN 0 THEN '{{"status": "Normal", "explanation": "line ' || line_id || '"}}'
    WHEN 1 THEN '```json' || chr(10) || '{{"status": "Anomalous", "explanation": "line ' || line_id || '"}}' || chr(10) || '```'
    WHEN 2 THEN '{{"status": "Normal", "explanation": "x"}} and more'
    WHEN 3 THEN '{{"status": "Normal"}}'
    WHEN 4 THEN 'no json, just ' || line_id
    ELSE '{{"status": "Normal", "explanation": "x"}}, {{"status": "Normal", "explanation": "y"}}' END AS reply
  FROM log_lines)"""


@DASHBOARD.add(
    f"""WITH {_REPLIES_SQL},
bare AS (SELECT line_id, trim(replace(replace(reply, '```json', ''), '```', ''), chr(10) || ' ') AS b FROM replies),
good AS (SELECT *, json_valid(b) AND coalesce(json_exists(CASE WHEN json_valid(b) THEN b END, '$.status')
                                               AND json_exists(CASE WHEN json_valid(b) THEN b END, '$.explanation'), false) AS ok FROM bare)
SELECT line_id, CASE WHEN ok THEN json_extract_string(CASE WHEN ok THEN b END, '$.status') ELSE 'Unknown' END AS status,
       CASE WHEN ok THEN json_extract_string(CASE WHEN ok THEN b END, '$.explanation') ELSE b END AS explanation FROM good"""
)
def reply_parse(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("line_id")
    s = i.cast("string")
    one = lambda status: F.concat(F.lit(f'{{"status": "{status}", "explanation": "line '), s, F.lit('"}'))
    reply = (
        F.when(i % 6 == 0, one("Normal"))
        .when(i % 6 == 1, F.concat(F.lit("```json\n"), one("Anomalous"), F.lit("\n```")))
        .when(i % 6 == 2, F.lit('{"status": "Normal", "explanation": "x"} and more'))
        .when(i % 6 == 3, F.lit('{"status": "Normal"}'))
        .when(i % 6 == 4, F.concat(F.lit("no json, just "), s))
        .otherwise('{"status": "Normal", "explanation": "x"}, {"status": "Normal", "explanation": "y"}')
    )
    parsed = v.log_lines(spark, folder).select("line_id", sc.parsed_reply(reply).alias("r"))
    return parsed.select("line_id", "r.status", "r.explanation")


_EXPLAINER_SQL = "'Below is an anomalous HDFS log sequence. Explain what went wrong.' || chr(10) || chr(10) || '### Sequence:' || chr(10) || '[''' || array_to_string(sequence, ''', ''') || ''']' || chr(10) || chr(10) || '### Latency:' || chr(10) || latency::BIGINT || '.0 sec' || chr(10) || chr(10) || '### Explanation:' || chr(10)"


@DASHBOARD.add(f"WITH {VERDICT_SQL} SELECT block_id, {_EXPLAINER_SQL} AS prompt, 'from model' AS answer FROM judged")
def explainer_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt per session, and the answer cut from prompt plus model output."""
    prompt = render.explainer_prompt(F.col("sequence"), F.col("latency"))
    rows = v.sessions(spark, folder).withColumn("prompt", prompt)
    answer = sc.extracted(F.concat("prompt", F.lit(" from model \n")))
    return rows.select("block_id", "prompt", answer.alias("answer"))


def _verdict_prompt_sql() -> str:
    form = fv.VERDICT_PROMPT.replace("{{", "{").replace("}}", "}")
    listed = lambda items: f"'[''' || array_to_string({items}, ''', ''') || ''']'"
    from logweft.plans.parsing import _EVENT_TEXT

    slots = {
        "block_id": "block_id",
        "texts": listed(f"list_transform(sequence, lambda e: {_EVENT_TEXT}[e])"),
        "events": listed("sequence"),
        "latency": "latency::BIGINT || '.0'",
    }
    parts, rest = [], form
    for name, sql in slots.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [v._quoted(before), f"({sql})"]
    return " || ".join([*parts, v._quoted(rest)])


@DASHBOARD.add(f"WITH {v.SESSIONS_SQL} SELECT block_id, {_verdict_prompt_sql()} AS prompt FROM sessions")
def verdict_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.sessions(spark, folder, with_text=True)
    prompt = render.verdict_prompt(F.col("block_id"), F.col("text_sequence"), F.col("sequence"), F.col("latency"))
    return rows.select("block_id", prompt.alias("prompt"))


@DASHBOARD.add(
    f"""WITH {VERDICT_SQL}
SELECT block_id, CASE WHEN verdict = 'anomalous' THEN 'Anomalous' ELSE 'Normal' END AS status,
       CASE WHEN verdict = 'anomalous' THEN 'events ' || array_to_string(sequence, ',') ELSE '{fv.NORMAL_REPLY}' END AS explanation
FROM judged"""
)
def request_results(spark: SparkSession, folder: str) -> DataFrame:
    """The request path over a table: messages, content, verdict, result."""
    rows = v.sessions(spark, folder, with_text=True).withColumn("content", sm.join_messages(F.col("text_sequence")))
    scored = sc.score(rows).withColumn("prediction", sc.prediction(F.col("verdict")))
    return sc.verdicts(scored, F.concat(F.lit("events "), F.array_join("sequence", ",")))


_CONFIDENCE_SQL = """greatest(60, least(99, CASE WHEN status = 'Anomalous' THEN 82 ELSE 95 END
       - CASE WHEN latency > 15 THEN 8 ELSE 0 END - CASE WHEN list_contains(events, 'E22') THEN 5 ELSE 0 END
       - CASE WHEN list_contains(events, 'E11') THEN 3 ELSE 0 END))"""
_SEVERITY_SQL = "CASE WHEN status = 'Normal' THEN 'Low' WHEN latency > 20 THEN 'Critical' WHEN latency > 15 THEN 'High' WHEN latency > 10 THEN 'Medium' ELSE 'Low' END"


@DASHBOARD.add(
    f"""WITH {HISTORY_SQL}
SELECT id, status, {_CONFIDENCE_SQL} AS confidence, {_SEVERITY_SQL} AS severity,
       'Status: ' || status || chr(10) || 'Confidence: ' || {_CONFIDENCE_SQL} || '%' || chr(10) || 'Severity: ' || {_SEVERITY_SQL} || chr(10) || 'Explanation:' || chr(10) || explanation AS report
FROM history"""
)
def severity_confidence(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    scored = _history(spark, folder).withColumns(
        {
            "confidence": db.confidence(c("status"), c("latency"), c("events")),
            "severity": db.severity(c("status"), c("latency")),
        }
    )
    report = db.report_text(c("status"), c("confidence"), c("severity"), c("explanation"))
    return scored.select("id", "status", "confidence", "severity", report.alias("report"))


@DASHBOARD.add(
    f"""WITH {HISTORY_SQL}
SELECT id, array_to_string(CASE WHEN status = 'Normal' THEN ['Continue monitoring', 'No immediate action required']
  ELSE list_filter([CASE WHEN list_contains(events, 'E5') THEN 'Check DataNode availability' END,
                    CASE WHEN list_contains(events, 'E11') THEN 'Verify PacketResponder process' END,
                    CASE WHEN list_contains(events, 'E22') THEN 'Inspect replication pipeline' END,
                    'Review recent cluster logs'], lambda x: x IS NOT NULL) END, '; ') AS actions FROM history"""
)
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    actions = db.recommendations(F.col("status"), F.col("events"))
    return _history(spark, folder).select("id", F.array_join(actions, "; ").alias("actions"))


@DASHBOARD.add(
    f"""WITH {HISTORY_SQL}, s AS (
SELECT count(*) AS total, count(*) FILTER (status = 'Anomalous') AS anomalies, count(*) FILTER (status = 'Normal') AS healthy,
       avg(latency) AS avg_latency FROM history)
SELECT *, (floor(avg_latency * 100 + 0.5)::BIGINT // 100) || '.' || lpad((floor(avg_latency * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') AS shown FROM s"""
)
def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    return db.stats(_history(spark, folder)).withColumn("shown", db.two_decimals(F.col("avg_latency")))


@DASHBOARD.add(
    f"""WITH {HISTORY_SQL}
SELECT id, count(*) OVER w AS total, count(*) FILTER (status = 'Anomalous') OVER w AS anomalies,
       count(*) FILTER (status = 'Normal') OVER w AS healthy, sum(latency) OVER w / count(*) OVER w AS avg_latency
FROM history WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)"""
)
def running_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = db.running_stats(_history(spark, folder), line_cells("id"), ["id"], store=True)
    return rows.select("id", "total", "anomalies", "healthy", "avg_latency")


@DASHBOARD.add(
    f"""WITH {HISTORY_SQL}, c AS (SELECT status, count(*) AS n FROM history WHERE status IN ('Normal', 'Anomalous') GROUP BY status)
SELECT status, n, floor(n * 100 / sum(n) OVER () + 0.5)::BIGINT AS percent FROM c"""
)
def health_share(spark: SparkSession, folder: str) -> DataFrame:
    return db.health_share(_history(spark, folder))


@DASHBOARD.add(
    f"WITH {HISTORY_SQL} SELECT (hour(ts) // 2 * 2)::INTEGER AS slot, count(*) AS anomalies FROM history WHERE status = 'Anomalous' GROUP BY ALL"
)
def anomalies_2h(spark: SparkSession, folder: str) -> DataFrame:
    return db.two_hour_anomalies(_history(spark, folder))


@DASHBOARD.add(
    f"WITH {HISTORY_SQL} SELECT id, block_id, status FROM history WHERE contains(lower(block_id), 'k_10') OR contains(lower(status), 'k_10')"
)
def history_search(spark: SparkSession, folder: str) -> DataFrame:
    return db.sort_history(db.search(_history(spark, folder), "K_10")).select("id", "block_id", "status")


@DASHBOARD.add(
    f"WITH {HISTORY_SQL} SELECT id, block_id, explanation[1:140] || '…' AS preview FROM history WHERE status = 'Anomalous'"
)
def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return db.newest_first(db.alerts(_history(spark, folder)))


@DASHBOARD.add(
    f"WITH {HISTORY_SQL} SELECT id, block_id FROM history WHERE status = 'Anomalous' AND id NOT IN (SELECT doc_id FROM labels)"
)
def open_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts without the dismissed ones."""
    dismissed = v.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return db.newest_first(db.dismiss(db.alerts(_history(spark, folder)), dismissed)).select("id", "block_id")


@DASHBOARD.add(
    f"""WITH {v.LINES_SQL},
told AS (SELECT line_id, value AS text, regexp_extract(value, 'blk_-?\\d+') AS block_id FROM log_lines),
top AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_id DESC) AS r FROM told WHERE block_id <> '')
SELECT block_id, string_agg(text, ', ' ORDER BY r) AS context FROM top WHERE r <= 5 GROUP BY block_id"""
)
def recent_context(spark: SparkSession, folder: str) -> DataFrame:
    from logweft.functions import text as tx

    lines = v.log_lines(spark, folder).select("line_id", F.col("value").alias("text"), tx.block_id(F.col("value")).alias("block_id"))
    return db.recent_context(lines.filter("block_id IS NOT NULL"), ["block_id"], "line_id")
