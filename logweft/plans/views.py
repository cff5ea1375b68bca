"""Stand-in inputs derived from the given tables, in Spark and in SQL.

``log_lines`` turns the events table into raw log text; everything else is
derived from it with the library's own operators. The SQL twins are written
separately, so a query and its check share no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv
from logweft.operators import lines as ln, sessions as ss
from logweft.operators.templates import Template, vocabulary

# Message texts, each fitting its own template first. {b} is the block id.
MESSAGES = [
    "Adding an already existing block {b} on volume /data/dn2",
    "Verification succeeded for {b} after 3 reads",
    "10.1.2.14:50010 Served block {b} to /10.1.2.31",
    "10.1.2.14:50010:Got exception while serving {b} to /10.1.2.31:",
    "Receiving block {b} src: /10.1.2.14:41016 dest: /10.1.2.31:50010",
    "Received block {b} src: /10.1.2.14:41016 dest: /10.1.2.31:50010 of size 67108864",
    "writeBlock {b} received exception java.io.IOException: broken pipe",
    "PacketResponder {b} 2 for block {b} Interrupted.",
    "Received block {b} of size 67108864 from /10.1.2.14",
    "PacketResponder {b} 1 Exception java.io.EOFException",
    "PacketResponder 0 for block {b} terminating",
    "10.1.2.14:50010:Exception writing block {b} to mirror 10.1.2.31:50010",
    "Receiving empty packet for block {b}",
    "Exception in receiveBlock for block {b} java.io.IOException",
    "Changing block file offset of block {b} from 0 to 4096 meta file offset to 39",
    "10.1.2.14:50010:Transmitted block {b} to /10.1.2.31:50010",
    "10.1.2.14:50010:Failed to transfer {b} to 10.1.2.31:50010 got java.net.SocketException",
    "10.1.2.14:50010 Starting thread to transfer block {b} to 10.1.2.31:50010",
    "Reopen Block {b}",
    "Unexpected error trying to delete block {b}. BlockInfo not found in volumeMap.",
    "Deleting block {b} file /data/dn2/current/{b}",
    "BLOCK* NameSystem.allocateBlock: /user/job/part-00004. {b}",
    "BLOCK* NameSystem.delete: {b} is added to invalidSet of 10.1.2.14:50010",
    "BLOCK* Removing block {b} from neededReplications as it does not belong to any file",
    "BLOCK* ask 10.1.2.14:50010 to replicate {b} to datanode(s) 10.1.2.31:50010",
    "BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.1.2.14:50010 is added to {b} size 67108864",
    "BLOCK* NameSystem.addStoredBlock: Redundant addStoredBlock request received for {b} on 10.1.2.14:50010 size 67108864",
    "BLOCK* NameSystem.addStoredBlock: addStoredBlock request received for {b} on 10.1.2.14:50010 size 67108864 But it does not belong to any file.",
    "PendingReplicationMonitor timed out block {b}",
    "BLOCK* ask 10.1.2.14:50010 to delete {b}",
    "Heartbeat mentions {b} at True speed, ticket deadbeef from admin@node-7 on Mon",
    "RECEIVING BLOCK {b} SRC: /10.1.2.14:41016 DEST: /10.1.2.31:50010",
]
TYPES = ["0", "1", "3", "4", "5", "7", "9", "16", "21", "31", "8", "3.0", ""]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def templates() -> list[Template]:
    return vocabulary(fv.TEMPLATES_30)


# -- Spark side ------------------------------------------------------------


def lines_of(events: DataFrame) -> DataFrame:
    """Raw log lines of an events frame, batch or stream. Narrow: no shuffle."""
    e = F.col("event_id")
    block = F.concat(F.lit("blk_"), (F.col("user_id") * 8 + F.floor(e / 32) % 8).cast("string"))
    stamp = F.date_format("ts", "yyMMdd HHmmss")
    k = (e % 32).cast("int")
    message = F.replace(F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), k + 1), F.lit("{b}"), block)
    value = (
        F.when(e % 97 == 0, F.lit(""))
        .when(e % 89 == 0, F.concat(stamp, F.lit(" 7 INFO dfs.DataNode: periodic report without a subject")))
        .when(e % 83 == 0, F.concat(F.lit("081399 256199 7 INFO dfs.DataNode: "), message))
        .otherwise(F.concat(stamp, F.lit(" 7 INFO dfs.DataNode: "), message))
    )
    zero = F.lit(0).cast("bigint")
    return events.select(value.alias("value"), zero.alias("file_key"), zero.alias("block_start"), e.alias("line_id"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return lines_of(events)


def occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return ln.events(log_lines(spark, folder), templates())


def sessions(spark: SparkSession, folder: str, **options) -> DataFrame:
    sizes = ln.line_blocks(log_lines(spark, folder))
    return ss.sessions(occurrences(spark, folder), templates(), sizes=sizes, **options)


def session_parts(spark: SparkSession, folder: str, part_events: int, **options) -> DataFrame:
    sizes = ln.line_blocks(log_lines(spark, folder))
    return ss.session_parts(occurrences(spark, folder), templates(), part_events, sizes=sizes, **options)


def session_heads(spark: SparkSession, folder: str, most: int, **options) -> DataFrame:
    sizes = ln.line_blocks(log_lines(spark, folder))
    return ss.session_heads(occurrences(spark, folder), templates(), most, sizes=sizes, **options)


def _block_number() -> Column:
    return F.substring("block_id", 5, 20).cast("bigint")


def traces_of(session_rows: DataFrame) -> DataFrame:
    """Sessions in the shape of the labelled-trace file: every field is text."""
    n = F.col("_n")
    gaps = F.concat(
        F.lit("["),
        F.array_join(F.transform("gaps", lambda g: F.concat(g.cast("bigint").cast("string"), F.lit(".0"))), ", "),
        F.lit("]"),
    )
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (n % len(TYPES)).cast("int") + 1)
    return session_rows.withColumn("_n", _block_number()).select(
        F.col("block_id").alias("BlockId"),
        F.when(n % 3 == 0, "Fail").otherwise("Success").alias("Label"),
        kind.alias("Type"),
        F.when(n % 41 == 0, "[]")
        .otherwise(F.concat(F.lit("["), F.array_join("sequence", ","), F.lit("]")))
        .alias("Features"),
        F.when(n % 37 == 0, F.lit("[0.0, oops")).otherwise(gaps).alias("TimeInterval"),
        F.when(n % 29 == 0, F.lit("")).otherwise(F.col("latency").cast("string")).alias("Latency"),
        F.col("first_seen.line_id").alias("line_id"),
    )


def traces(spark: SparkSession, folder: str) -> DataFrame:
    return traces_of(sessions(spark, folder, with_gaps=True))


def daily_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Traces of one block and day each (day 0 for events without a time): short
    ones, of which many are equal. The number is block * 100 + day."""
    day = F.coalesce(F.dayofmonth("ts"), F.lit(0))
    number = _block_number() * 100 + day
    daily = occurrences(spark, folder).withColumn("block_id", F.concat(F.lit("blk_"), number.cast("string")))
    return traces_of(ss.sessions(daily, templates(), with_gaps=True))


# -- SQL side --------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(_quoted(i) for i in items) + "]"


def _sql_pattern(template: str) -> str:
    import re

    pieces = [re.escape(p).replace("\\ ", r"\s+") for p in template.split("<*>")]
    return "(?is)" + ".*?".join(pieces)


def _first_match() -> str:
    tests = " ".join(
        f"WHEN regexp_matches(value, {_quoted(_sql_pattern(t))}) THEN {_quoted(i)}" for i, t in fv.TEMPLATES_30
    )
    return f"CASE {tests} END"


LINES_SQL = f"""
raw_lines AS (
  SELECT event_id AS line_id,
         'blk_' || (user_id * 8 + (event_id // 32) % 8) AS blk,
         strftime(ts, '%y%m%d %H%M%S') AS stamp,
         {_sql_list(MESSAGES)}[(event_id % 32) + 1] AS message
  FROM events),
log_lines AS (
  SELECT line_id,
         CASE WHEN line_id % 97 = 0 THEN ''
              WHEN line_id % 89 = 0 THEN stamp || ' 7 INFO dfs.DataNode: periodic report without a subject'
              WHEN line_id % 83 = 0 THEN '081399 256199 7 INFO dfs.DataNode: ' || replace(message, '{{b}}', blk)
              ELSE stamp || ' 7 INFO dfs.DataNode: ' || replace(message, '{{b}}', blk) END AS value
  FROM raw_lines)"""

MARKED_SQL = f"""{LINES_SQL},
with_block AS (
  SELECT line_id, value, nullif(regexp_extract(value, 'blk_-?\\d+'), '') AS block_id FROM log_lines),
with_event AS (
  SELECT *, CASE WHEN block_id IS NOT NULL THEN {_first_match()} END AS event FROM with_block),
marked AS (
  SELECT *,
         CASE WHEN value = '' THEN 'blank' WHEN block_id IS NULL THEN 'no_block'
              WHEN event IS NULL THEN 'unmatched' ELSE 'matched' END AS reason,
         try_strptime(regexp_extract(value, '^(\\d{{6}})\\s+(\\d{{6}})', 1)
                      || regexp_extract(value, '^(\\d{{6}})\\s+(\\d{{6}})', 2), '%y%m%d%H%M%S') AS ts
  FROM with_event)"""

SESSIONS_SQL = f"""{MARKED_SQL},
occ AS (SELECT block_id, ts, event, line_id FROM marked WHERE reason = 'matched'),
gapped AS (
  SELECT *, coalesce(date_diff('second', lag(ts) OVER w, ts), 0) AS gap
  FROM occ WINDOW w AS (PARTITION BY block_id ORDER BY ts NULLS LAST, line_id)),
sessions AS (
  SELECT block_id,
         list(event ORDER BY ts NULLS LAST, line_id) AS sequence,
         list(gap ORDER BY ts NULLS LAST, line_id) AS gaps,
         CASE WHEN count(ts) >= 2 THEN date_diff('second', min(ts), max(ts)) ELSE 0 END::DOUBLE AS latency,
         min(ts) AS first_ts, count(*) AS n_events, min(line_id) AS first_line,
         substr(block_id, 5)::BIGINT AS n
  FROM gapped GROUP BY block_id)"""


TRACES_SQL = f"""{SESSIONS_SQL},
traces AS (
  SELECT block_id AS BlockId,
         CASE WHEN n % 3 = 0 THEN 'Fail' ELSE 'Success' END AS Label,
         {_sql_list(TYPES)}[(n % {len(TYPES)}) + 1] AS Type,
         CASE WHEN n % 41 = 0 THEN '[]' ELSE '[' || array_to_string(sequence, ',') || ']' END AS Features,
         CASE WHEN n % 37 = 0 THEN '[0.0, oops'
              ELSE '[' || array_to_string(list_transform(gaps, lambda g: g || '.0'), ', ') || ']' END AS TimeInterval,
         CASE WHEN n % 29 = 0 THEN '' ELSE latency::BIGINT || '.0' END AS Latency,
         first_line AS line_id
  FROM sessions)"""

DAILY_TRACES_SQL = TRACES_SQL.replace(
    "SELECT block_id, ts, event, line_id FROM marked",
    "SELECT 'blk_' || (substr(block_id, 5)::BIGINT * 100 + coalesce(day(ts), 0)) AS block_id, ts, event, line_id FROM marked",
)
