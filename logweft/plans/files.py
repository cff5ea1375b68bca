"""Queries that go through files: what each sink writes is read back by its source.

Inputs are derived from the given tables and written as several files below the shared
folder, so readers see splits, several files, quoting and broken lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv, schemas
from logweft.functions import render
from logweft.operators import quality as ql, samples as sm, scoring as sc, sessions as ss
from logweft.operators.ranking import SOURCE_ORDER, rank_rows, source_cells
from logweft.operators.templates import load_templates
from logweft.plans import jobs, views as v
from logweft.plans.dashboard import HISTORY_SQL
from logweft.plans.registry import Registry
from logweft.session import materialize, new_folder
from logweft.sources import json_array, logs, sinks, tables

FILES = Registry()
PARTS = 5  # files that an input is written as


def _log_folder(spark: SparkSession, folder: str) -> str:
    """The derived log as text files whose names follow the order of their lines."""
    path = new_folder(spark, "log")
    ordered = v.log_lines(spark, folder).repartitionByRange(PARTS, "line_id").sortWithinPartitions("line_id")
    ordered.select("value").write.text(path)
    return path


def _template_file(spark: SparkSession) -> str:
    """The 30 templates as the file a user brings: one CSV in matching order."""
    path = new_folder(spark, "templates")
    rows = spark.createDataFrame(fv.TEMPLATES_30, schemas.TEMPLATES_CSV).coalesce(1)
    rows.write.csv(path, header=True, quote='"', escape='"')
    return path


@FILES.add(f"WITH {v.LINES_SQL} SELECT row_number() OVER (ORDER BY line_id) - 1 AS position, value FROM log_lines")
def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of several text files with their place in the whole source."""
    rows = logs.read_log(spark, _log_folder(spark, folder))
    return rank_rows(rows, "position", source_cells(), list(SOURCE_ORDER)).select("position", "value")


def _python_list(column: str) -> str:
    return f"'[' || array_to_string(list_transform({column}, lambda e: '''' || e || ''''), ', ') || ']'"


@FILES.add(f"WITH {v.SESSIONS_SQL} SELECT block_id, {_python_list('sequence')} AS sequence, latency FROM sessions")
def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """A log folder and a template file to session CSV files, read back."""
    parsed = jobs.parse_log(spark, _log_folder(spark, folder), load_templates(spark, _template_file(spark)))
    ss.require_rows(parsed.occurrences, "matched lines")
    path = new_folder(spark, "session-csv")
    sinks.write_sessions_csv(parsed.sessions, path)
    back = spark.read.schema("block_id string, sequence string, text_sequence string, latency double")
    return back.csv(path, header=True, quote='"', escape='"').select("block_id", "sequence", "latency")


_TEXTS = "MAP {" + ", ".join(f"'{i}': {v._quoted(t)}" for i, t in fv.TEMPLATES_30) + "}"


@FILES.add(
    f"""WITH {v.SESSIONS_SQL}
SELECT array_to_string(list_transform(sequence, lambda e: {_TEXTS}[e]), '{fv.MESSAGE_JOIN}') AS content, 0 AS label, count(*) AS n
FROM sessions GROUP BY 1"""
)
def content_files(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier contents written as CSV and read back, counted by text."""
    rows = v.sessions(spark, folder, with_text=True)
    contents = sm.unlabelled(rows.select(sm.join_messages(F.col("text_sequence")).alias("content")))
    path = new_folder(spark, "content-csv")
    sinks.write_contents_csv(contents, path)
    back = spark.read.schema("content string, label int").csv(path, header=True, quote='"', escape='"')
    return back.groupBy("content", "label").agg(F.count(F.lit(1)).alias("n"))


@FILES.add(
    f"""WITH {v.TRACES_SQL}
SELECT BlockId AS block_id, Label AS label, nullif(Type, '') AS kind, Features AS features, TimeInterval AS gaps,
       nullif(Latency, '') AS latency FROM traces"""
)
def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled traces from several CSV files with quoted lists."""
    path = new_folder(spark, "trace-csv")
    rows = v.traces(spark, folder).select(*schemas.TRACES_CSV.fieldNames()).repartition(PARTS, "BlockId")
    rows.write.csv(path, header=True, quote='"', escape='"')
    empty = lambda name, alias: F.nullif(F.col(name), F.lit("")).alias(alias)
    return tables.read_traces(spark, path).select(
        F.col("BlockId").alias("block_id"),
        F.col("Label").alias("label"),
        empty("Type", "kind"),
        F.col("Features").alias("features"),
        F.col("TimeInterval").alias("gaps"),
        empty("Latency", "latency"),
    )


@FILES.add(
    "SELECT 'blk_' || doc_id AS block_id, CASE WHEN toxic = 1 THEN 'Anomaly' WHEN toxic = 0 THEN 'Normal' END AS label FROM labels"
)
def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """Block labels from several CSV files."""
    path = new_folder(spark, "label-csv")
    rows = v.table(spark, folder, "labels").select(
        F.concat(F.lit("blk_"), "doc_id").alias("BlockId"), F.when(F.col("toxic") == 1, "Anomaly").when(F.col("toxic") == 0, "Normal").alias("Label")
    )
    rows.repartition(PARTS, "BlockId").write.csv(path, header=True, quote='"', escape='"')
    return tables.read_labels(spark, path).select(F.col("BlockId").alias("block_id"), F.col("Label").alias("label"))


@FILES.add(
    """SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS answer FROM documents WHERE doc_id % 5 NOT IN (3, 4)"""
)
def chat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chat records from JSON lines, among blank lines and lines cut in the middle."""
    docs = v.table(spark, folder, "documents")
    answer = F.regexp_replace("text", r"\s+", " ")
    record = F.to_json(F.struct(render.chat("s", F.col("doc_id").cast("string"), answer).alias("messages")))
    kind = F.col("doc_id") % 5
    line = F.when(kind == 3, "").when(kind == 4, F.substring(record, 1, 40)).otherwise(record)
    path = new_folder(spark, "chat-lines")
    docs.select(line.alias("value")).repartition(PARTS).write.text(path)
    said = lambda i: F.get(F.col("messages"), i)["content"]
    return tables.read_json_lines(spark, path).select(said(1).cast("bigint").alias("doc_id"), said(2).alias("answer"))


@FILES.add(
    f"""WITH {HISTORY_SQL},
read AS (SELECT block_id, explanation FROM history)
SELECT block_id, explanation, 'json' AS form FROM read UNION ALL SELECT block_id, explanation, 'csv' FROM read
UNION ALL SELECT block_id, explanation, 'parquet' FROM read"""
)
def explanation_files(spark: SparkSession, folder: str) -> DataFrame:
    """Explanations written in each form and read back."""
    rows = v.sessions(spark, folder).select(
        "block_id", F.concat(F.lit("events "), F.array_join("sequence", " then ")).alias("explanation"), "sequence"
    )
    found = None
    for form in ("json", "csv", "parquet"):
        path = new_folder(spark, f"explanations-{form}")
        sinks.write_explanations(rows, path, form)
        reader = spark.read.schema("block_id string, explanation string").options(header=True, quote='"', escape='"')
        part = reader.format(form).load(path).select("block_id", "explanation", F.lit(form).alias("form"))
        found = part if found is None else found.unionByName(part)
    return found


_ODD = r'"},{ ]\\" } [ '  # brackets, quotes and escapes inside a string


@FILES.add(f"WITH {HISTORY_SQL} SELECT block_id, explanation || ' {_ODD}' AS explanation FROM history")
def json_array_files(spark: SparkSession, folder: str) -> DataFrame:
    """Explanations as files of one JSON array each, read in splits."""
    rows = v.sessions(spark, folder).select(
        "block_id", F.concat(F.lit("events "), F.array_join("sequence", " then "), F.lit(f" {_ODD}")).alias("explanation"), "sequence"
    )
    part = F.pmod(F.hash("block_id"), F.lit(PARTS))
    chunk = F.pmod(F.xxhash64("block_id"), F.lit(64))
    some = rows.groupBy(part.alias("part"), chunk.alias("chunk")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    arrays = some.groupBy("part").agg(F.to_json(F.flatten(F.collect_list("rows"))).alias("value"))
    path = new_folder(spark, "json-arrays")
    arrays.write.partitionBy("part").text(path)
    return json_array.read_json_array(spark, f"{path}/*", schemas.EXPLANATIONS).select("block_id", "explanation")


def _tail(prompt: str) -> str:
    """A stand-in for a language model: some of what it was asked."""
    if prompt.startswith("#"):
        raise RuntimeError("the model is down")
    return " " + prompt[-40:]


_ASKED_SQL = f"""{v.LINES_SQL},
asked AS (SELECT line_id, CASE WHEN line_id % 50 = 0 THEN '#' ELSE '' END || value AS prompt FROM log_lines WHERE value <> ''),
told AS (SELECT line_id, CASE WHEN line_id % 50 <> 0 THEN trim(right(prompt, 40)) END AS answer FROM asked)"""


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts, dealt to all cores: a table of few splits would be asked by as few tasks."""
    mark = F.when(F.col("line_id") % 50 == 0, "#").otherwise("")
    lines = v.log_lines(spark, folder).filter("value <> ''").repartition(2 * spark.sparkContext.defaultParallelism, "line_id")
    return lines.select("line_id", F.concat(mark, "value").alias("prompt"))


@FILES.add(f"WITH {_ASKED_SQL} SELECT line_id, answer FROM told")
def generation_hook(spark: SparkSession, folder: str) -> DataFrame:
    """A caller's generator, with calls that never succeed."""
    return sc.generate(_asked(spark, folder), _tail, output="answer", wait=0.0).select("line_id", "answer")


@FILES.add(
    f"""WITH {_ASKED_SQL},
gated AS (SELECT answer, CASE WHEN answer IS NULL THEN '{fv.CALL_FAILED}'
                              WHEN length(answer) < 30 THEN 'too short (' || length(answer) || ' chars)'
                              WHEN len(list_filter(string_split(answer, '.'), lambda s: length(trim(s)) > {fv.MIN_SENTENCE_CHARS})) < {fv.MIN_SENTENCES}
                              THEN 'fewer than 2 real sentences' ELSE 'ok' END AS reason FROM told)
SELECT reason, 2 * count(*) AS n FROM gated GROUP BY reason"""
)
def appended_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Two appended batches of gated answers, counted by reason from what was written."""
    told = materialize(sc.generate(_asked(spark, folder), _tail, output="answer", wait=0.0), "answers")
    gated = ql.gate(told, "answer", min_chars=30).select(
        F.col("line_id").cast("string").alias("block_id"),
        F.array(F.lit("E5")).alias("sequence"),
        "ok",
        "reason",
        F.when(F.col("answer").isNotNull(), render.chat("s", F.lit("u"), F.col("answer"))).alias("messages"),
    )
    accepted, rejected = new_folder(spark, "accepted"), new_folder(spark, "rejected")
    for _ in range(2):
        sinks.append_by_verdict(gated, accepted, rejected)
    good = tables.read_json_lines(spark, accepted).select(F.lit("ok").alias("reason"))
    bad = tables.read_json_lines(spark, rejected, schemas.REJECTS).select(F.coalesce("reason", "_reject_reason").alias("reason"))
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _says(texts: list[str]) -> list[str]:
    return ["ANOMALOUS" if "exception" in t.lower() else "normal" for t in texts]


@FILES.add(
    f"""WITH {v.SESSIONS_SQL},
judged AS (SELECT block_id, contains(lower(array_to_string(list_transform(sequence, lambda e: {_TEXTS}[e]), '{fv.MESSAGE_JOIN}')), 'exception') AS bad FROM sessions)
SELECT block_id, CASE WHEN bad THEN 'Anomalous' ELSE 'Normal' END AS status,
       CASE WHEN bad THEN 'looked at' ELSE {v._quoted(fv.NORMAL_REPLY)} END AS explanation FROM judged"""
)
def request_path(spark: SparkSession, folder: str) -> DataFrame:
    """The whole request path with a scorer and a generator."""
    rows = v.sessions(spark, folder, with_text=True).select(
        "block_id",
        F.col("text_sequence").alias("semantic_text_sequence"),
        F.col("sequence").alias("event_id_sequence"),
        "latency",
    )
    return jobs.analyze_requests(rows, _says, lambda prompt: prompt + "looked at")
