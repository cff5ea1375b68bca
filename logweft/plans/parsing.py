"""Queries on raw lines: parsing, counters, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv, schemas
from logweft.functions import text as tx
from logweft.operators import lines as ln, sessions as ss, vocabulary as vc
from logweft.plans import views as v
from logweft.plans.registry import Registry
from logweft.session import materialize, new_folder

PARSING = Registry()


@PARSING.add(
    f"""WITH {v.MARKED_SQL}
SELECT count(*) AS total, count(*) FILTER (reason = 'blank') AS blank,
       count(*) FILTER (reason = 'no_block') AS no_block,
       count(*) FILTER (reason = 'unmatched') AS unmatched,
       count(*) FILTER (reason = 'matched') AS matched,
       count(DISTINCT block_id) FILTER (reason = 'matched') AS unique_blocks
FROM marked"""
)
def parse_counters(spark: SparkSession, folder: str) -> DataFrame:
    return ln.parse_counters(ln.mark_lines(v.log_lines(spark, folder), v.templates()))


@PARSING.add(
    f"""WITH {v.MARKED_SQL}
SELECT line_id, block_id, event AS event_id, reason FROM marked"""
)
def line_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with its block, first matching event and keep/drop reason."""
    marked = ln.mark_lines(v.log_lines(spark, folder), v.templates())
    return ln.named_events(marked, v.templates()).select("line_id", "block_id", "event_id", "reason")


@PARSING.add(
    f"""WITH {v.MARKED_SQL}
SELECT line_id, ts FROM marked"""
)
def timestamp_parse(spark: SparkSession, folder: str) -> DataFrame:
    line = tx.clean_line(F.col("value"))
    return v.log_lines(spark, folder).select("line_id", tx.log_time(line).alias("ts"))


@PARSING.add(
    f"""WITH {v.SESSIONS_SQL}
SELECT block_id, array_to_string(sequence, ',') AS sequence, n_events, latency FROM sessions"""
)
def block_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: raw lines to one ordered session per block."""
    return v.sessions(spark, folder).select(
        "block_id", F.array_join("sequence", ",").alias("sequence"), "n_events", "latency"
    )


_EVENT_TEXT = "MAP {" + ", ".join(f"'{i}': {v._quoted(t)}" for i, t in fv.TEMPLATES_30) + "}"


@PARSING.add(
    f"""WITH {v.SESSIONS_SQL}
SELECT block_id, array_to_string(list_transform(sequence, lambda e: {_EVENT_TEXT}[e]), ' ;-; ') AS content, 0 AS label
FROM sessions"""
)
def session_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier input text of each session: template texts joined."""
    rows = v.sessions(spark, folder, with_text=True)
    return rows.select(
        "block_id", F.array_join("text_sequence", fv.MESSAGE_JOIN).alias("content"), F.lit(0).alias("label")
    )


@PARSING.add(
    f"""WITH {v.MARKED_SQL}
SELECT block_id, {", ".join(f"count(*) FILTER (event = '{i}') AS {i}" for i, _ in fv.TEMPLATES_30)}
FROM marked WHERE reason = 'matched' GROUP BY block_id"""
)
def event_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return ss.event_matrix(v.occurrences(spark, folder), v.templates())


_ORDINAL = "MAP {" + ", ".join(f"'{i}': {n}" for n, (i, _) in enumerate(fv.TEMPLATES_30)) + "}"


@PARSING.add(
    f"""WITH {v.MARKED_SQL},
cells AS (SELECT block_id, {_ORDINAL}[event] AS ord, count(*) AS n FROM marked WHERE reason = 'matched' GROUP BY 1, 2)
SELECT block_id, string_agg(ord, ',' ORDER BY ord) AS ords, string_agg(n, ',' ORDER BY ord) AS counts FROM cells GROUP BY block_id"""
)
def sparse_event_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The event counts of each block as lists, whatever the size of the vocabulary."""
    rows = ss.sparse_event_matrix(v.occurrences(spark, folder))
    return rows.select("block_id", F.array_join("ords", ",").alias("ords"), F.array_join("counts", ",").alias("counts"))


@PARSING.add(
    f"""WITH {v.MARKED_SQL},
occ AS (SELECT ts::DATE AS day, block_id FROM marked WHERE reason = 'matched' AND ts IS NOT NULL)
SELECT count(*) AS n_events, count(DISTINCT block_id) AS unique_blocks, true AS estimate_holds FROM occ
WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'"""
)
def range_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of a range of days from stored daily rows, beside the exact number."""
    found = v.occurrences(spark, folder)
    first, last = (F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-19"))
    stored = materialize(ln.daily_counters(found), "daily-counters")
    told = ln.counters_between(stored, first, last)
    exact = found.filter(F.to_date("ts").between(first, last)).agg(F.count_distinct("block_id").alias("exact")).scalar()
    near = F.abs(F.col("unique_blocks") - exact) <= exact * ln.SKETCH_ERROR + 1
    return told.select("n_events", exact.alias("unique_blocks"), near.alias("estimate_holds"))


@PARSING.add(
    f"""WITH {v.SESSIONS_SQL}
SELECT block_id, array_to_string(list_transform(sequence[1:8], lambda e: {_EVENT_TEXT}[e]), ' ;-; ') AS content,
       n_events, latency
FROM sessions"""
)
def session_head_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight messages of each block, beside facts of all its events. Blocks of
    more than six events are put in order in parts, of which no whole row is made."""
    rows = v.session_heads(spark, folder, most=8, part_events=6, with_text=True)
    content = F.array_join("text_sequence", fv.MESSAGE_JOIN).alias("content")
    return rows.select("block_id", content, "n_events", "latency")


@PARSING.add(
    f"""WITH {v.SESSIONS_SQL}
SELECT block_id, array_to_string(sequence, ',') AS sequence, latency FROM sessions ORDER BY first_line LIMIT 3"""
)
def session_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = ss.preview(v.sessions(spark, folder))
    return rows.select("block_id", F.array_join("sequence", ",").alias("sequence"), "latency")


@PARSING.add(
    f"""WITH {v.MARKED_SQL},
numbered AS (
  SELECT block_id, line_id, event, ts,
         row_number() OVER (PARTITION BY block_id ORDER BY ts NULLS LAST, line_id) - 1 AS pos
  FROM marked WHERE reason = 'matched')
SELECT block_id, line_id, event AS event_id, pos FROM numbered"""
)
def event_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every event in its block, by the route that holds for huge blocks."""
    numbered = ss.numbered_events(v.occurrences(spark, folder))
    return ln.named_events(numbered, v.templates()).select("block_id", "line_id", "event_id", "pos")


_VOCABULARY = 20_000  # templates: those of the given list after many others of the same shape


def _vocabulary_files(spark: SparkSession) -> list[str]:
    """The 30 templates among 20 000, as three files in matching order."""
    number = F.col("id").cast("string")
    head = F.element_at(F.array(*[F.lit(m.split("{b}")[0].strip() or "block") for m in v.MESSAGES]), (F.col("id") % len(v.MESSAGES)).cast("int") + 1)
    others = spark.range(_VOCABULARY).select(
        F.concat(F.lit("X"), number).alias("EventId"), F.concat(head, F.lit(" <*> part"), number, F.lit(" <*>")).alias("EventTemplate")
    )
    half = _VOCABULARY // 2
    given = spark.createDataFrame(fv.TEMPLATES_30, schemas.TEMPLATES_CSV).coalesce(1)
    paths = []
    for rows in (others.filter(F.col("EventId").substr(2, 9).cast("int") < half), given, others.filter(F.col("EventId").substr(2, 9).cast("int") >= half)):
        paths.append(f"{new_folder(spark, 'vocabulary')}-{len(paths)}")
        rows.write.csv(paths[-1], header=True, quote='"', escape='"')
    return paths


@PARSING.add(f"WITH {v.MARKED_SQL} SELECT line_id, block_id, event AS event_id, ts FROM marked WHERE reason = 'matched'")
def vocabulary_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Lines searched for 20 030 templates out of several files; those of the given list match."""
    index = vc.template_index(vc.load_vocabulary(spark, _vocabulary_files(spark)))
    return vc.events(v.log_lines(spark, folder), index).select("line_id", "block_id", "event_id", "ts")


@PARSING.add(
    f"""WITH {v.SESSIONS_SQL}
SELECT block_id, array_to_string(sequence, ',') AS sequence, n_events, latency FROM sessions"""
)
def vocabulary_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a large vocabulary: event ids travel with the events."""
    index = vc.template_index(vc.load_vocabulary(spark, _vocabulary_files(spark)))
    found = vc.events(v.log_lines(spark, folder), index).drop("ord").withColumnRenamed("event_id", "ord")
    return ss.sessions(found, None).select(
        "block_id", F.array_join("sequence", ",").alias("sequence"), "n_events", "latency"
    )


_KEYWORDS = "list_filter([CASE WHEN contains(value, 'PacketResponder') THEN 'E11' END, CASE WHEN contains(value, 'Received block') THEN 'E22' END, CASE WHEN contains(value, 'terminating') THEN 'E5' END], lambda x: x IS NOT NULL)"


@PARSING.add(
    f"""WITH {v.LINES_SQL},
hits AS (SELECT line_id, value, {_KEYWORDS} AS found,
                nullif(regexp_extract(value, 'blk_[-0-9]+'), '') AS loose FROM log_lines)
SELECT line_id, coalesce(loose, 'generated') AS block,
       CASE WHEN len(found) > 0 THEN array_to_string(found, ', ') ELSE 'E1' END AS events
FROM hits"""
)
def keyword_events(spark: SparkSession, folder: str) -> DataFrame:
    """Dashboard reading of a live line: loose block id and guessed events."""
    line = F.col("value")
    loose = tx.loose_block_id(line)
    generated = F.regexp_extract(line, tx.LOOSE_BLOCK_ID, 0) == ""
    return v.log_lines(spark, folder).select(
        "line_id",
        F.when(generated, "generated").otherwise(loose).alias("block"),
        F.array_join(tx.keyword_events(line), ", ").alias("events"),
    )


@PARSING.add(
    f"""WITH {v.LINES_SQL},
parts AS (SELECT line_id, list_transform(string_split(value, ','), lambda p: trim(p)) AS items FROM log_lines)
SELECT line_id, len(items) AS all_items, len(list_filter(items, lambda p: p <> '')) AS filled_items,
       array_to_string(items, '|') AS joined FROM parts"""
)
def comma_lists(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("value")
    every = tx.comma_list(line, keep_empty=True)
    return v.log_lines(spark, folder).select(
        "line_id",
        F.size(every).cast("bigint").alias("all_items"),
        F.size(tx.comma_list(line)).cast("bigint").alias("filled_items"),
        F.array_join(every, "|").alias("joined"),
    )
