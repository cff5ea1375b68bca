"""End-to-end jobs: what a user runs on files.

Each stage that feeds more than one consumer is stored once in the shared
folder, so text is parsed and models are called a single time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from logweft import fixed_values as fv, schemas
from logweft.functions import render
from logweft.operators import curate as cu, explain as ex, lines as ln, quality as ql
from logweft.operators import samples as sm, scoring as sc, sessions as ss, traces as tr
from logweft.operators.ranking import SOURCE_ORDER, source_cells, source_order
from logweft.operators.templates import Template
from logweft.session import materialize, new_folder
from logweft.sources import logs, sinks, tables

EXPLAIN_LIMIT = 0  # anomalies to explain; 0 means all
Generator = Callable[[str], str]


@dataclass
class ParsedLog:
    """Stored occurrences, sessions on top of them, and the line counters."""

    occurrences: DataFrame
    sessions: DataFrame
    counters: dict[str, int]


def parse_log(spark: SparkSession, log_path: str, templates: list[Template], with_text: bool = True) -> ParsedLog:
    """Raw log to sessions. The counters are observed while the occurrences are
    written, at no extra pass."""
    seen = Observation("parse")
    count = lambda reason: F.count_if(F.col("reason") == reason).alias(reason)
    reasons = ("blank", "no_block", "unmatched", "matched")
    marked = ln.mark_lines(logs.read_log(spark, log_path), templates).observe(
        seen, F.count(F.lit(1)).alias("total"), *[count(reason) for reason in reasons]
    )
    occurrences = materialize(ln.matched_events(marked), "occurrences")
    rows = ss.sessions(occurrences, templates, with_text=with_text, with_gaps=True, sizes=occurrences)
    return ParsedLog(occurrences, rows, seen.get)


def detect_and_explain(
    spark: SparkSession,
    log_path: str,
    templates: list[Template],
    out: str,
    scorer: sc.Scorer | None = None,
    generator: Generator | None = None,
    explain_limit: int = EXPLAIN_LIMIT,
) -> dict[str, int]:
    """Raw log to sessions, verdicts and explanations of the first anomalies.

    Without a scorer the built-in rule decides; without a generator the explanation
    is put together by rules from the sequence. Prompts are written either way.
    """
    parsed = parse_log(spark, log_path, templates)
    ss.require_rows(parsed.occurrences, "matched lines")
    sinks.write_sessions(parsed.sessions, f"{out}/sessions")
    stored = spark.read.schema(parsed.sessions.schema).parquet(f"{out}/sessions")

    contents = sm.unlabelled(stored.withColumn("content", sm.join_messages(F.col("text_sequence"))))
    sinks.write_contents_csv(contents, f"{out}/contents")
    scored = sc.score(sm.prepare(contents), scorer).withColumn("prediction", sc.prediction(F.col("verdict")))
    verdicts = materialize(scored.drop("messages", "content", "text_sequence"), "verdicts")
    flagged = ss.require_rows(sc.anomalies(verdicts), "anomalies")

    chosen = sc.first_to_explain(flagged, "first_seen", explain_limit)
    asked = chosen.withColumn("prompt", render.explainer_prompt(F.col("sequence"), F.col("latency")))
    if generator is None:
        told = ex.rule_explanation(asked)
    else:
        told = sc.generate(asked, generator).withColumn("explanation", sc.extracted(F.col("explanation")))
    told.select("block_id", "sequence", "latency", "prompt", "explanation").write.mode("overwrite").json(
        f"{out}/explanations"
    )
    return parsed.counters | {"sessions": stored.count(), "anomalies": flagged.count()}


def analyze_requests(requests: DataFrame, scorer: sc.Scorer | None = None, generator: Generator | None = None) -> DataFrame:
    """The request path over a table or a stream of requests.

    With a generator, scoring and generation are one step over each batch, so every
    row is scored once, and only anomalous rows reach the generator, once each; a
    stream needs no stored copy for that.
    """
    rows = requests.withColumns(
        {
            "content": sm.join_messages(F.col("semantic_text_sequence")),
            "sequence": F.col("event_id_sequence"),
        }
    )
    rows = sm.prepare(rows).drop("messages")
    prompt = render.explainer_prompt(F.col("sequence"), F.col("latency"))
    if generator is None:
        scored = sc.score(rows, scorer)
        return sc.verdicts(scored.withColumn("prediction", sc.prediction(F.col("verdict"))), prompt)
    if scorer is None:
        rows = sc.score(rows).withColumn("prompt", prompt)
        answered = sc.score_and_generate(rows, None, generator)
    else:
        answered = sc.score_and_generate(rows.withColumn("prompt", prompt), scorer, generator)
    return sc.verdicts(answered, sc.extracted(F.col("answer")))


def explain_traces(spark: SparkSession, traces_path: str, out: str) -> DataFrame:
    """Labelled traces to rule-based explanations and the whole validation report: totals
    (also returned), rows per type and per number of sentences, event codes that slipped
    in, samples per type and of the rotation, skipped rows by reason and the first ten."""
    checked = materialize(tr.checked_traces(tables.read_traces(spark, traces_path)), "checked")
    valid = checked.filter("skip_reason IS NULL").drop("skip_reason")
    told = ex.explanations(valid, tr.anomaly_types(spark), source_cells(), SOURCE_ORDER)
    sinks.write_explanations(told, f"{out}/explanations", "parquet")
    stored = spark.read.schema(told.schema).parquet(f"{out}/explanations")
    sinks.write_explanations(
        stored.select("block_id", "anomaly_type", "sequence", "explanation"), f"{out}/explanations_json"
    )
    placed = stored.withColumn("_at", source_order())
    parts = {
        "skipped": tr.skip_report(checked),
        "first_skipped": tr.first_skipped(checked.withColumn("_at", source_order()), "_at"),
        "types": ql.breakdown(stored),
        "sentences": ql.sentence_distribution(stored),
        "leaked_codes": ql.leaked_codes(stored),
        "first_samples": ql.first_per_type(placed, F.col("_at")),
        "rotation_samples": ql.rotation_sample(placed, "_at"),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{out}/{name}")
    report = ql.report(stored)
    report.write.mode("overwrite").json(f"{out}/report")
    return spark.read.schema(report.schema).json(f"{out}/report")


def sampled_generation(
    spark: SparkSession,
    traces_path: str,
    templates: list[Template],
    generator: Generator,
    accepted_path: str,
    rejected_path: str,
    sample_size: int = fv.SAMPLE_SIZE,
    seed: int = fv.SAMPLE_SEED,
    wait: float = 4.0,
    parallel: int = 1,
    per_second: float = 0.0,
) -> DataFrame:
    """Distinct anomalous sequences, sampled, minus those done before, explained
    by the generator and appended to the accepted or rejected file.

    Answers are kept in a ledger beside the accepted file as they come, and stored before
    they are split: a job that died half-way makes no call twice.
    """
    usable = cu.usable(tr.sampled_traces(tables.read_traces(spark, traces_path)))
    sample = cu.sample_rows(cu.first_of_each_sequence(usable, source_order()), sample_size, seed)
    done = cu.processed_ids(
        tables.read_json_lines(spark, accepted_path, schemas.REJECTS),
        tables.read_json_lines(spark, rejected_path, schemas.REJECTS),
    )
    rest = cu.remaining(sample, done).select("block_id", "anomaly_type", "sequence", "latency")
    prompt = render.generator_prompt(
        F.col("block_id"), F.col("sequence"), templates, F.col("anomaly_type"), F.col("latency")
    )
    asked = rest.withColumn("prompt", prompt)
    ledger = f"{accepted_path.rstrip('/')}-calls"
    told = sc.generate(asked, generator, wait=wait, parallel=parallel, per_second=per_second, ledger=ledger)
    answered = materialize(told, "answers")
    gated = ql.gate(answered, "explanation")
    chat = F.when(F.col("explanation").isNotNull(), render.sampled_chat(F.col("explanation")))
    sinks.append_by_verdict(gated.withColumn("messages", chat), accepted_path, rejected_path)
    return ql.low_yield(gated)


def training_records(spark: SparkSession, explanations_path: str, out: str) -> None:
    """Explanation file to chat records, one per line."""
    rows = tables.read_explanations(spark, explanations_path)
    rows.select(render.training_chat(F.col("explanation")).alias("messages")).write.mode("overwrite").json(out)


def combine_and_split(spark: SparkSession, first: str, second: str, out: str, validation: float = 0.1) -> dict[str, int]:
    """Two chat files: union, keep-first on the answer, seeded split."""
    both = cu.union_in_order(
        tables.read_json_lines(spark, first), tables.read_json_lines(spark, second), source_order()
    )
    answer = F.get(F.col("messages"), 2)["content"]
    read, kept = Observation("read"), Observation("kept")
    count = F.count(F.lit(1)).alias("n")
    answered = both.withColumn("answer", answer).observe(read, count)
    first = cu.first_of_each_text(answered, "answer").select("answer", "messages", F.to_json("source_order").alias("row_key"))
    unique = materialize(first.observe(kept, count), "unique")
    parts = new_folder(spark, "split")
    cu.split_rows(unique, "row_key", validation).select("split", "messages").write.partitionBy("split").parquet(parts)
    split = spark.read.schema(T.StructType([*unique.select("messages").schema.fields, T.StructField("split", T.StringType())])).parquet(parts)
    for name in ("train", "val"):  # ranked once, above
        split.filter(F.col("split") == name).select("messages").write.mode("overwrite").json(f"{out}/{name}")
    total, unique_rows = read.get["n"], kept.get["n"]
    return {"total": total, "unique": unique_rows, "removed": total - unique_rows}


def type_distribution(records: DataFrame) -> DataFrame:
    """Records per anomaly type named in the user message."""
    user = F.get(F.col("messages"), 1)["content"]
    return ql.breakdown(records.withColumn("kind", cu.recovered_type(user)), "kind").orderBy(F.desc("n"), "kind")


def label_windows(
    spark: SparkSession, traces_path: str, labels_path: str, templates: list[Template], window: int = 20, stride: int = 10
) -> DataFrame:
    """Traces joined with labels and cut into labelled windows."""
    joined = tr.label_join(tables.read_traces(spark, traces_path), tables.read_labels(spark, labels_path))
    return tr.window_rows(joined.select("block_id", "label", "events"), templates, window, stride)
