"""Queries on classifier samples and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv
from logweft.functions import render, text as tx
from logweft.operators import curate as cu, packing as pk, samples as sm, traces as tr
from logweft.operators.ranking import line_cells
from logweft.plans import views as v
from logweft.plans.registry import Registry
from logweft.plans.traces import VALID_SQL

TRAINING = Registry()

MASK_SQL = "|".join(fv.MASK_PATTERNS)
MASKED_SQL = f"""{v.LINES_SQL},
masked AS (
  SELECT line_id, (line_id % 7 = 0)::INTEGER AS label,
         regexp_replace(regexp_replace(value, '[.]{{3,}}', '.. ', 'g'), '{MASK_SQL}', '<*>', 'g') AS content
  FROM log_lines)"""


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return v.log_lines(spark, folder).select(
        "line_id", F.col("value").alias("content"), (F.col("line_id") % 7 == 0).cast("int").alias("label")
    )


@TRAINING.add(f"WITH {MASKED_SQL} SELECT line_id, content FROM masked")
def mask_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return sm.prepare(_samples(spark, folder)).select("line_id", "content")


@TRAINING.add(
    f"WITH {MASKED_SQL} SELECT content, min(line_id) AS line_id, arg_min(label, line_id) AS label FROM masked GROUP BY content"
)
def masked_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """First line of each masked text."""
    return sm.prepare(_samples(spark, folder), F.col("line_id")).select("content", "line_id", "label")


@TRAINING.add(
    f"""WITH {MASKED_SQL}, firsts AS (SELECT content, arg_min(label, line_id) AS label FROM masked GROUP BY content)
SELECT 'before' AS stage, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS anomalous FROM masked
UNION ALL SELECT 'after', count(*) FILTER (label = 0), count(*) FILTER (label = 1) FROM firsts"""
)
def dedup_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    before = sm.class_counts(_samples(spark, folder)).withColumn("stage", F.lit("before"))
    after = sm.class_counts(sm.prepare(_samples(spark, folder), F.col("line_id"))).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


# -- balancing -------------------------------------------------------------


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    return v.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))


PLAN_SQL = """sizes AS (SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1 FROM labels),
ordered AS (SELECT CASE WHEN n1 < n0 THEN 1 ELSE 0 END AS minority_label, least(n0, n1) AS n_minority,
                   greatest(n0, n1) AS n_majority FROM sizes),
aimed AS (SELECT *, greatest(floor((0.3 * n_majority) / (1 - 0.3))::BIGINT, n_minority) AS minority_target FROM ordered),
plan AS (SELECT *, n_majority + minority_target AS combined FROM aimed)"""


@TRAINING.add(
    f"WITH {PLAN_SQL} SELECT minority_label, n_minority, n_majority, minority_target, greatest(combined, 50000) AS total FROM plan"
)
def balance_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = sm.plan_for(_classes(spark, folder))
    return spark.createDataFrame(
        [(plan.minority_label, plan.n_minority, plan.n_majority, plan.minority_target, plan.total)],
        "minority_label int, n_minority bigint, n_majority bigint, minority_target bigint, total bigint",
    )


OVERSAMPLED_SQL = f"""{PLAN_SQL},
ranked AS (SELECT doc_id, toxic AS label,
                  row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id)) - 1 AS r FROM labels),
copied AS (
  SELECT doc_id, label, CASE WHEN label <> minority_label THEN 1
                             ELSE minority_target // n_minority + (r < minority_target % n_minority)::BIGINT END AS n
  FROM ranked, plan),
combined_rows AS (SELECT doc_id, label, unnest(range(1, n + 1)) AS copy FROM copied)"""


@TRAINING.add(f"WITH {OVERSAMPLED_SQL} SELECT doc_id AS id, label, copy FROM combined_rows")
def oversampled(spark: SparkSession, folder: str) -> DataFrame:
    classes = _classes(spark, folder)
    return sm.oversample(classes, sm.plan_for(classes)).select("id", "label", F.col("copy").cast("bigint").alias("copy"))


@TRAINING.add(
    f"""WITH {OVERSAMPLED_SQL},
tiled AS (SELECT doc_id, label, copy, unnest(range(1, 50000 // combined + 1)) AS tile FROM combined_rows, plan),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('43|' || doc_id || '|' || copy || '|' || tile)) - 1 AS r FROM tiled),
sized AS (SELECT doc_id, label, 1 + (r < 50000 % combined)::INTEGER AS n FROM placed, plan)
SELECT doc_id AS id, label, sum(n)::BIGINT AS n FROM sized GROUP BY ALL"""
)
def balanced_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each sample occurs in the balanced set of 50 000."""
    classes = _classes(spark, folder)
    rows = sm.balanced(classes, sm.plan_for(classes))
    return rows.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))


@TRAINING.add(
    f"""WITH {OVERSAMPLED_SQL},
placed AS (SELECT *, row_number() OVER (ORDER BY md5('43|' || doc_id || '|' || copy || '|1')) - 1 AS r FROM combined_rows)
SELECT doc_id AS id, label, copy FROM placed, plan WHERE r < n_majority // 2"""
)
def downsampled(spark: SparkSession, folder: str) -> DataFrame:
    """A balanced set capped at half the majority class."""
    classes = _classes(spark, folder)
    half = sm.plan_for(classes).n_majority // 2
    rows = sm.balanced(classes, sm.plan_for(classes, max_samples=half))
    return rows.select("id", "label", F.col("copy").cast("bigint").alias("copy"))


# -- packing ---------------------------------------------------------------

BATCH_SQL = f"""{v.SESSIONS_SQL},
placed AS (SELECT *, row_number() OVER (ORDER BY first_line) - 1 AS position FROM sessions),
batched AS (
  SELECT position // 16 AS batch_id, position, sequence[1:128] AS messages,
         CASE WHEN n % 7 = 0 THEN 'anomalous' ELSE 'normal' END AS label FROM placed),
grouped AS (
  SELECT batch_id, list(messages ORDER BY position) AS lists, list(label ORDER BY position) AS labels
  FROM batched GROUP BY batch_id)"""


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    n = F.substring("block_id", 5, 20).cast("bigint")
    heads = v.session_heads(spark, folder, most=pk.MAX_MESSAGES)
    rows = heads.select(
        F.col("sequence").alias("messages"),
        (n % 7 == 0).cast("int").alias("label"),
        F.col("first_seen.line_id").alias("line_id"),
    )
    return pk.pack(pk.batches(rows, line_cells(), ["line_id"], store=True))


@TRAINING.add(
    f"""WITH {BATCH_SQL}
SELECT batch_id, array_to_string(flatten(lists), ',') AS data, array_to_string(labels, ',') AS labels,
       array_to_string(list_transform(range(1, len(lists)), lambda i: list_sum(list_transform(lists[1:i], lambda l: len(l)))::BIGINT), ',') AS starts
FROM grouped"""
)
def pack_batches(spark: SparkSession, folder: str) -> DataFrame:
    join = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return _packed(spark, folder).select("batch_id", join("data"), join("starts"), join("labels"))


def _pad_sql(left: bool) -> str:
    fill = lambda item, filler: (
        f"list_concat(list_resize([]::{filler[1]}[], width - len(l), {filler[0]}), {item})"
        if left
        else f"list_concat({item}, list_resize([]::{filler[1]}[], width - len(l), {filler[0]}))"
    )
    return f"""WITH {BATCH_SQL},
wide AS (SELECT *, list_max(list_transform(lists, lambda l: len(l))) AS width FROM grouped)
SELECT batch_id,
       array_to_string(list_transform(lists, lambda l: array_to_string({fill("l", ("'-'", "VARCHAR"))}, ',')), '|') AS padded,
       array_to_string(list_transform(lists, lambda l: array_to_string({fill("list_transform(l, lambda x: 1)", ("0", "INTEGER"))}, ',')), '|') AS mask
FROM wide"""


def _padded(spark: SparkSession, folder: str, left: bool) -> DataFrame:
    rows = pk.pad_batches(_packed(spark, folder), filler="-", left=left)
    nested = lambda name: F.array_join(
        F.transform(name, lambda items: F.array_join(items.cast("array<string>"), ",")), "|"
    ).alias(name)
    return rows.select("batch_id", nested("padded"), nested("mask"))


@TRAINING.add(_pad_sql(left=False))
def pad_right(spark: SparkSession, folder: str) -> DataFrame:
    return _padded(spark, folder, left=False)


@TRAINING.add(_pad_sql(left=True))
def pad_left(spark: SparkSession, folder: str) -> DataFrame:
    return _padded(spark, folder, left=True)


# -- curation --------------------------------------------------------------

SAMPLED_SQL = f"""{v.TRACES_SQL},
sampled AS (
  SELECT BlockId AS block_id, trunc(Type::DOUBLE)::INTEGER AS anomaly_type, try_cast(nullif(Latency, '') AS DOUBLE) AS latency, line_id,
         list_filter(string_split(trim(Features, '[]'), ','), lambda e: e <> '') AS sequence
  FROM traces WHERE Type <> ''),
usable AS (SELECT * FROM sampled WHERE len(sequence) BETWEEN 3 AND 60)"""


def _usable(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    return cu.usable(tr.sampled_traces(v.traces(spark, folder) if rows is None else rows))


@TRAINING.add(
    f"""WITH {SAMPLED_SQL.replace(v.TRACES_SQL, v.DAILY_TRACES_SQL)}
SELECT md5(array_to_string(sequence, ',')) AS fingerprint, arg_min(block_id, line_id) AS block_id,
       arg_min(anomaly_type, line_id) AS anomaly_type FROM sampled GROUP BY 1"""
)
def sequence_fingerprint_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.sampled_traces(v.daily_traces(spark, folder))
    return cu.first_of_each_sequence(rows, "line_id").select("fingerprint", "block_id", "anomaly_type")


DONE_SQL = """done AS (SELECT 'blk_' || doc_id AS block_id FROM labels WHERE toxic = 1
          UNION SELECT 'blk_' || doc_id FROM labels WHERE quality = 0)"""
SAMPLE_SQL = f"""{SAMPLED_SQL}, {DONE_SQL},
sample AS (SELECT * FROM usable ORDER BY md5('42|' || block_id), block_id LIMIT 700)"""


def _done(spark: SparkSession, folder: str) -> DataFrame:
    """Ids seen earlier: some in a field, some only in a chat record."""
    rows = v.table(spark, folder, "labels").withColumn("block_id", F.concat(F.lit("blk_"), F.col("doc_id")))
    rejected = rows.filter("toxic = 1").select("block_id", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"))
    user = render.user_message(F.col("block_id"), F.lit(1), F.lit("['E5']"), F.lit(1), F.lit("3 seconds"))
    accepted = rows.filter("quality = 0").select(
        render.chat(fv.SYSTEM_PROMPT_SAMPLED, user, F.lit("text")).alias("messages")
    )
    return cu.processed_ids(accepted, rejected)


@TRAINING.add(f"WITH {SAMPLE_SQL} SELECT block_id, anomaly_type FROM sample WHERE block_id NOT IN (SELECT block_id FROM done)")
def resume_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    sample = cu.sample_rows(_usable(spark, folder))
    return cu.remaining(sample, _done(spark, folder)).select("block_id", "anomaly_type")


LATENCY_TEXT_SQL = """CASE WHEN latency IS NULL THEN 'unknown'
     WHEN latency < 60 THEN floor(latency + 0.5)::BIGINT || ' seconds'
     WHEN latency < 3600 THEN (floor((latency * 10 + 30) / 60)::BIGINT // 10) || '.' || (floor((latency * 10 + 30) / 60)::BIGINT % 10) || ' minutes'
     ELSE (floor((latency * 10 + 1800) / 3600)::BIGINT // 10) || '.' || (floor((latency * 10 + 1800) / 3600)::BIGINT % 10) || ' hours' END"""
_SQL_IDS = "[" + ", ".join(f"'{i}'" for i, _ in fv.TEMPLATES_30) + "]"
_SQL_TEXTS = "MAP {" + ", ".join(f"'{i}': {v._quoted(t)}" for i, t in fv.TEMPLATES_30) + "}"


def _prompt_sql() -> str:
    form = fv.GENERATOR_PROMPT
    slots = {
        "glossary": f"array_to_string(list_transform(list_filter(firsts, lambda e: list_contains({_SQL_IDS}, e)), lambda e: '  ' || e || ': ' || {_SQL_TEXTS}[e]), chr(10))",
        "block_id": "block_id",
        "anomaly_type": "anomaly_type",
        "latency": LATENCY_TEXT_SQL,
        "sequence": "array_to_string(sequence, ' -> ')",
        "repeats": "CASE WHEN len(often) = 0 THEN '' ELSE chr(10) || 'Repeated events: ' || array_to_string(list_transform(often, lambda c: c.event || ' appears ' || -c.less || 'x'), ', ') END",
    }
    parts, rest = [], form
    for name, sql in slots.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [v._quoted(before), f"({sql})"]
    parts.append(v._quoted(rest))
    return " || ".join(parts)


@TRAINING.add(
    f"""WITH {SAMPLED_SQL},
uniq AS (SELECT *, list_filter(sequence, lambda e, i: list_position(sequence, e) = i) AS firsts FROM usable),
counted AS (
  SELECT *, list_sort(list_filter(list_transform(firsts, lambda e, i:
    {{'less': -len(list_filter(sequence, lambda o: o = e)), 'seen': i, 'event': e}}), lambda c: c.less < -1)) AS often
  FROM uniq)
SELECT block_id, {_prompt_sql()} AS prompt FROM counted"""
)
def generator_prompts(spark: SparkSession, folder: str) -> DataFrame:
    prompt = render.generator_prompt(
        F.col("block_id"), F.col("sequence"), v.templates(), F.col("anomaly_type"), F.col("latency")
    )
    return _usable(spark, folder).select("block_id", prompt.alias("prompt"))


@TRAINING.add(
    f"""WITH {VALID_SQL}
SELECT block_id, 3 AS n_messages, {v._quoted(fv.SYSTEM_PROMPT_TRAINING)} AS system_text,
       'Block: ' || block_id || chr(10) || 'Anomaly Type: ' || anomaly_type || chr(10) || 'Sequence: [' || array_to_string(sequence, ', ') || ']'
       || chr(10) || 'Sequence Length: ' || len(sequence) || CASE WHEN latency IS NULL THEN '' ELSE chr(10) || 'Latency: ' || latency::BIGINT || '.0s' END AS user_text,
       'type ' || anomaly_type AS answer
FROM valid"""
)
def chat_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.valid_traces(v.traces(spark, folder))
    answer = F.concat(F.lit("type "), F.col("anomaly_type").cast("string"))
    made = rows.withColumn("m", render.training_chat(answer, F.col("latency")))
    text = lambda i, name: F.col("m")[i]["content"].alias(name)
    return made.select("block_id", F.size("m").alias("n_messages"), text(0, "system_text"), text(1, "user_text"), text(2, "answer"))


CORPUS_SQL = """corpus AS (
  SELECT doc_id, text, CASE WHEN substr(source, 4)::INTEGER % 2 = 0 THEN 0 ELSE 1 END AS file FROM documents),
firsts AS (SELECT text, arg_min(doc_id, (file, doc_id)) AS doc_id FROM corpus GROUP BY text)"""


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    docs = v.table(spark, folder, "documents").select("doc_id", "text", "source")
    even = F.substring("source", 4, 9).cast("int") % 2 == 0
    both = cu.union_in_order(docs.filter(even), docs.filter(~even), "doc_id")
    return cu.first_of_each_text(both.drop("source"), "text")


@TRAINING.add(f"WITH {CORPUS_SQL} SELECT doc_id, length(text) AS n_chars FROM firsts")
def corpus_union_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"))


@TRAINING.add(
    f"WITH {CORPUS_SQL} SELECT (SELECT count(*) FROM corpus) AS before, (SELECT count(*) FROM firsts) AS after, (SELECT count(*) FROM corpus) - (SELECT count(*) FROM firsts) AS removed"
)
def corpus_dedup_counts(spark: SparkSession, folder: str) -> DataFrame:
    before = v.table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("before"))
    after = _corpus(spark, folder).agg(F.count(F.lit(1))).scalar()
    return before.select("before", after.alias("after"), (F.col("before") - after).alias("removed"))


@TRAINING.add(
    f"""WITH {CORPUS_SQL},
placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS position FROM firsts)
SELECT doc_id, position, CASE WHEN position < floor((SELECT count(*) FROM firsts) * 0.9) THEN 'train' ELSE 'val' END AS split FROM placed"""
)
def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    return cu.split_rows(_corpus(spark, folder).select("doc_id"), "doc_id", store=True)


@TRAINING.add(
    f"""WITH {SAMPLED_SQL}
SELECT anomaly_type::VARCHAR AS kind, count(*) AS n FROM usable GROUP BY 1
UNION ALL SELECT 'unknown', count(*) FROM documents"""
)
def recovered_types(spark: SparkSession, folder: str) -> DataFrame:
    """Anomaly types read back from user messages; other texts have none."""
    events = F.col("sequence")
    told = _usable(spark, folder).select(
        render.user_message(
            F.col("block_id"), F.col("anomaly_type"), tx.python_list(events), F.size(events), tx.latency_text(F.col("latency"))
        ).alias("user")
    )
    texts = told.unionByName(v.table(spark, folder, "documents").select(F.col("text").alias("user")))
    return texts.groupBy(cu.recovered_type(F.col("user")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
