"""Queries that run the streaming operators over the events table and read the
drained result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv
from logweft.operators import sessions as ss
from logweft.plans import views as v, watch
from logweft.plans.registry import Registry
from logweft.session import new_folder
from logweft.sources import tail
from logweft.streaming import keyed, live

LIVE = Registry()


BATCHES = 5  # of rows in order; one more brings late ones
LATE_ROWS = "event_id % 50 = 7 AND event_id * 10 < (SELECT max(event_id) FROM events)"


def _files_per_batch(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism // 4)


def _with_lateness(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Events with ``late``: some of the first tenth, to be delivered after all others."""
    events = v.table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    last = events.agg(F.max("event_id")).first()[0] or 0
    return events.withColumn("late", F.expr(f"event_id % 50 = 7 AND event_id * 10 < {last}")), last


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of ``BATCHES`` batches in order and a late one: a file stream
    takes files by their times, so the batches are written one after the other."""
    events, last = _with_lateness(spark, folder)
    path, files = new_folder(spark, "events"), _files_per_batch(spark)
    step = last // BATCHES + 1
    for k in range(BATCHES + 1):
        own = events.filter("late") if k == BATCHES else events.filter(~F.col("late") & F.expr(f"event_id DIV {step} = {k}"))
        own.drop("late").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(events.drop("late").schema).option("maxFilesPerTrigger", files).parquet(path)


def _log_files(spark: SparkSession, folder: str) -> tuple[list[str], int]:
    """The derived log as text files whose names follow their lines, then files of late
    lines, and how many of them make a batch."""
    events, _ = _with_lateness(spark, folder)
    paths, files = [new_folder(spark, "tail"), new_folder(spark, "tail-late")], _files_per_batch(spark)
    for path, rows, count in ((paths[0], events.filter("NOT late"), BATCHES * files), (paths[1], events.filter("late"), files)):
        ordered = v.lines_of(rows).repartitionByRange(count, "line_id").sortWithinPartitions("line_id")
        ordered.select("value").write.text(path)
    return paths, files


def _log_tail(spark: SparkSession, folder: str) -> DataFrame:
    paths, files = _log_files(spark, folder)
    return tail.tail_log(spark, paths, files_per_batch=files)


def _verdict_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One scored request per event, as the dashboard receives them."""
    kind = F.col("event_id") % 5
    return _event_stream(spark, folder).select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("blk_"), F.col("user_id").cast("string")).alias("block_id"),
        F.when(kind == 0, "Anomalous").when(kind == 4, "Unknown").otherwise("Normal").alias("status"),
        F.col("value").alias("latency"),
    )


_VERDICTS_SQL = """verdicts AS (
  SELECT event_id AS id, ts, 'blk_' || user_id AS block_id, value AS latency,
         CASE event_id % 5 WHEN 0 THEN 'Anomalous' WHEN 4 THEN 'Unknown' ELSE 'Normal' END AS status FROM events)"""


@LIVE.add(
    f"""WITH {_VERDICTS_SQL}
SELECT count(*) AS total, count(*) FILTER (status = 'Anomalous') AS anomalies, count(*) FILTER (status = 'Normal') AS healthy,
       round(avg(latency), 6) AS avg_latency FROM verdicts"""
)
def stream_stats(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "stats")
    totals = live.running_stats(_verdict_stream(spark, folder))
    live.drain(totals, live.replace_table(path), f"{path}-state", "complete")
    return live.snapshot(spark, path).withColumn("avg_latency", F.round("avg_latency", 6))


def _windows_sql(rows: str) -> str:
    return f"""WITH {_VERDICTS_SQL}
SELECT epoch(time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '2000-01-01'))::BIGINT AS window_start, count(*) AS anomalies
FROM verdicts WHERE status = 'Anomalous' AND {rows} GROUP BY 1"""


@LIVE.add(_windows_sql("true"))
def stream_anomalies_2h(spark: SparkSession, folder: str) -> DataFrame:
    """All windows, the late rows counted in the ones they belong to."""
    path = new_folder(spark, "two-hours")
    live.drain(_verdict_stream(spark, folder), live.add_counts(path, live.anomaly_windows), f"{path}-state")
    counts = live.snapshot(spark, path)
    return counts.select(F.unix_seconds("window_start").alias("window_start"), F.col("n").alias("anomalies"))


_LATE = LATE_ROWS.replace("event_id %", "id %").replace("event_id *", "id *")


@LIVE.add(_windows_sql(f"NOT ({_LATE})"))
def stream_closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows as the watermark closes them, the last ones by a flush; late rows are dropped."""
    path = new_folder(spark, "closed-windows")
    marks = keyed.mark_stream(spark, f"{path}-marks")
    windows = live.two_hour_counts(_verdict_stream(spark, folder), marks=marks)
    live.drain(windows, live.append_once(path), f"{path}-state")
    keyed.request_flush(spark, f"{path}-marks")
    live.drain(windows, live.append_once(path), f"{path}-state")
    closed = spark.read.parquet(path)
    return closed.select(F.unix_seconds("window_start").alias("window_start"), "anomalies")


@LIVE.add(f"WITH {_VERDICTS_SQL} SELECT id, block_id FROM verdicts WHERE {_LATE}")
def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The side table of rows that came too late for the watermark."""
    path = new_folder(spark, "late")
    live.drain(_verdict_stream(spark, folder), live.keep_late(path), f"{path}-state")
    return spark.read.parquet(f"{path}/late").select("id", "block_id")


@LIVE.add(f"WITH {_VERDICTS_SQL} SELECT DISTINCT block_id FROM verdicts WHERE status = 'Anomalous'")
def stream_first_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with an alert, once each over all batches."""
    path = new_folder(spark, "first-alerts")
    alerts = live.once_per_key(live.alert_stream(_verdict_stream(spark, folder)), delay="1000 days")
    live.drain(alerts, live.append_once(path), f"{path}-state")
    return spark.read.parquet(path).select("block_id")


@LIVE.add(f"WITH {v.LINES_SQL} SELECT 'INFO' AS lvl, value AS text FROM log_lines WHERE value <> ''")
def live_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of growing files as the live view shows them, blank ones left out."""
    path = new_folder(spark, "feed")
    with live.caught_up(live.live_lines(_log_tail(spark, folder)), live.append_once(path), f"{path}-state"):
        return spark.read.parquet(path).select("lvl", "text")


@LIVE.add(f"WITH {v.LINES_SQL} SELECT value, count(*) AS n FROM log_lines GROUP BY value")
def tailed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of growing files, blank ones too, once."""
    path = new_folder(spark, "tailed")
    with live.caught_up(_log_tail(spark, folder), live.append_once(path), f"{path}-state"):
        return spark.read.parquet(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@LIVE.add(f"WITH {_VERDICTS_SQL} SELECT id, block_id FROM verdicts WHERE status = 'Anomalous'")
def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "alerts")
    live.drain(live.alert_stream(_verdict_stream(spark, folder)), live.append_once(path), f"{path}-state")
    return spark.read.parquet(path).select("id", "block_id")


@LIVE.add(f"WITH {v.LINES_SQL} SELECT line_id, value FROM log_lines WHERE value <> '' ORDER BY line_id DESC LIMIT 80")
def recent_buffer(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "recent")
    lines = v.lines_of(_event_stream(spark, folder)).filter("value <> ''").select("line_id", "value")
    live.drain(lines, live.keep_recent(path, "line_id"), f"{path}-state")
    return live.snapshot(spark, path)


_SPANS = f"""{v.MARKED_SQL},
timed AS (SELECT block_id, ts, event, line_id FROM marked
          WHERE reason = 'matched' AND ts IS NOT NULL AND NOT ({LATE_ROWS.replace("event_id %", "line_id %").replace("event_id *", "line_id *")})),
started AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh
  FROM timed WINDOW w AS (PARTITION BY block_id ORDER BY ts, line_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY block_id ORDER BY ts, line_id) AS s FROM started)"""
_SPANS_SQL = f"""{_SPANS}
SELECT block_id, epoch(min(ts))::BIGINT AS first_second, count(*) AS n_events, date_diff('second', min(ts), max(ts))::DOUBLE AS latency,
       string_agg(event, ',' ORDER BY ts, line_id) AS sequence
FROM numbered GROUP BY block_id, s"""


@LIVE.add(f"WITH {_SPANS_SQL}")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by inactivity gap from the tail of text files: late lines are dropped, and
    a flush closes what is open at the end."""
    path = new_folder(spark, "sessions")
    parsed = live.parse_stream(_log_tail(spark, folder), v.templates())
    closed = keyed.gap_sessions(parsed, 6 * 3600, marks=keyed.mark_stream(spark, f"{path}-marks"))
    with live.caught_up(closed, live.append_once(path), f"{path}-state") as query:
        keyed.request_flush(spark, f"{path}-marks")
        query.processAllAvailable()
    return spark.read.parquet(path).select(
        "block_id",
        F.unix_seconds("first_ts").alias("first_second"),
        "n_events",
        "latency",
        F.array_join(ss.named(F.col("ords"), v.templates()), ",").alias("sequence"),
    )


_EVENT_TEXTS = "MAP {" + ", ".join(f"'{i}': {v._quoted(t)}" for i, t in fv.TEMPLATES_30) + "}"


def _judge(texts: list[str]) -> list[str]:
    return ["anomalous" if "exception" in t.lower() else "normal" for t in texts]


@LIVE.add(
    f"""WITH {_SPANS},
judged AS (SELECT block_id, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(contains(lower({_EVENT_TEXTS}[event]), 'exception')) AS bad
           FROM numbered GROUP BY block_id, s)
SELECT count(*) AS total, count(*) FILTER (bad) AS anomalies, count(*) FILTER (NOT bad) AS healthy, count(*) FILTER (bad) AS alerts,
       round(avg(date_diff('second', first_ts, last_ts)), 6) AS avg_latency FROM judged"""
)
def watched_log(spark: SparkSession, folder: str) -> DataFrame:
    """The whole live job over growing files: its totals, and its alerts counted."""
    out = new_folder(spark, "watch")
    paths, files = _log_files(spark, folder)
    query = watch.watch_log(spark, paths, v.templates(), out, 6 * 3600, scorer=_judge, every="0 seconds", files_per_batch=files)
    watch.finish(query, spark, out)
    alerts = spark.read.parquet(f"{out}/alerts").agg(F.count(F.lit(1))).scalar()
    return watch.totals(spark, out).select(
        "total", "anomalies", "healthy", alerts.alias("alerts"), F.round("avg_latency", 6).alias("avg_latency")
    )
