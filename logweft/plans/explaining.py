"""Queries on sequence facts, explanations and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft import fixed_values as fv
from logweft.functions import sequences as sq
from logweft.operators import blocks as bl, explain as ex, quality as ql, traces as tr
from logweft.operators.ranking import line_cells
from logweft.plans import views as v
from logweft.plans.registry import Registry
from logweft.plans.traces import VALID_SQL
from logweft.session import materialize

EXPLAINING = Registry()


def _in(events: list[str], item: str) -> str:
    return f"{item} IN ({', '.join(v._quoted(e) for e in events)})"


def _members(events: list[str]) -> str:
    placed = "list_transform(sequence, lambda e, i: {'pos': i - 1, 'event': e})"
    return f"list_filter({placed}, lambda p: {_in(events, 'p.event')})"


def _pairs(first: str, second: str) -> str:
    return f"len(list_filter(range(1, len(sequence)), lambda i: sequence[i] = '{first}' AND sequence[i + 1] = '{second}'))"


def _count(event: str) -> str:
    return f"len(list_filter(sequence, lambda e: e = '{event}'))"


def features_sql(source: str) -> str:
    return f"""{source},
listed AS (
  SELECT *, len(sequence) AS length, {_members(fv.FAILURE_EVENTS)} AS failures, {_members(fv.CONTEXT_EVENTS)} AS context,
         {_pairs("E11", "E9")} AS norm_cycles, {_pairs("E26", "E23")} > 0 AS imm_inval,
         list_contains(sequence, 'E22') AND NOT list_contains(sequence, 'E26') AS alloc_no_reg,
         {_count("E3")} AS serve_count, {_count("E20")} AS lookup_misses,
         list_position(sequence, 'E22') - 1 AS first_allocation, list_position(sequence, 'E26') - 1 AS first_registration,
         list_max(list_transform(list_filter(range(1, least(len(sequence), len(time_interval)) + 1),
                                             lambda i: {_in(fv.CLEANUP_EVENTS, "sequence[i]")}),
                                 lambda i: time_interval[i])) AS cleanup_gap,
         list_max(time_interval) AS max_gap
  FROM valid),
feats AS (
  SELECT *, failures[1].pos AS first_fail_pos, failures[-1].pos AS last_fail_pos,
         len(list_filter(sequence[1 : coalesce(failures[1].pos, 0)], lambda e: {_in(fv.NORMAL_BEFORE_FAILURE, "e")})) AS pre_fail_normal,
         CASE WHEN latency < 5 THEN 'very_short' WHEN latency > 3600 AND length >= 4 THEN 'very_long'
              WHEN len(time_interval) > 1 AND cleanup_gap > 60 THEN 'long_gap_before_cleanup'
              WHEN len(time_interval) > 1 AND max_gap > 120 THEN 'long_gap'
              WHEN len(time_interval) > 1 AND max_gap > 30 THEN 'moderate_gap' END AS time_insight
  FROM listed)"""


FEATURES_SQL = features_sql(VALID_SQL)
DAILY_SQL = features_sql(VALID_SQL.replace(v.TRACES_SQL, v.DAILY_TRACES_SQL))

# One form of each kind of text, written with SQL replace().


def _fill_sql(form: str, **slots: str) -> str:
    sql = v._quoted(form)
    for name, value in slots.items():
        if "{" + name + "}" not in form:
            continue
        sql = f"replace({sql}, '{{{name}}}', ({value})::VARCHAR)"
    return sql


_PHRASE_MAP = "MAP {" + ", ".join(f"{v._quoted(k)}: {v._quoted(t)}" for k, t in fv.EVENT_PHRASES.items()) + "}"


def _listed_sql(column: str, more: tuple[str, str]) -> str:
    one = _fill_sql(fv.SIGNAL_AT, phrase=f"{_PHRASE_MAP}[s.event]", pos="s.pos")
    rest = f"CASE len({column}) WHEN 4 THEN [{v._quoted(more[0].replace('{n}', '1'))}] ELSE [{_fill_sql(more[1], n=f'len({column}) - 3')}] END"
    return f"array_to_string(list_concat(list_transform({column}[1:3], lambda s: {one}), CASE WHEN len({column}) > 3 THEN {rest} ELSE [] END), '; ')"


def told_sql(features: str) -> str:
    types = ", ".join(f"({k}, {v._quoted(c)}, {v._quoted(i)})" for k, _, c, i in fv.ANOMALY_TYPES)
    plain = v._sql_list(fv.OPENINGS_PLAIN)
    with_normal = v._sql_list(fv.OPENINGS_WITH_NORMAL)
    opening = f"CASE WHEN normal <> '' THEN {with_normal}[rotation + 1] ELSE {plain}[rotation + 1] END"
    for name, value in (
        ("signals", "signals"),
        ("normal", "normal"),
        ("cause", "cause"),
        ("impact_lower", "lower(impact[1]) || impact[2:]"),
        ("impact", "impact"),
    ):
        opening = f"replace({opening}, '{{{name}}}', {value})"
    times = " ".join(
        f"WHEN '{kind}' THEN {_fill_sql(form, latency='latency', seconds='latency::BIGINT')}"
        for kind, form in fv.TIME_TEXTS.items()
    )
    return f"""{features},
types(kind_no, cause, impact) AS (VALUES {types}),
turned AS (
  SELECT *, (row_number() OVER (PARTITION BY anomaly_type, array_to_string(sequence, ',') ORDER BY line_id) - 1) % 5 AS rotation,
         CASE WHEN len(failures) > 0 THEN {_listed_sql("failures", fv.MORE_FAILURES)}
              WHEN len(context) > 0 THEN {_listed_sql("context", fv.MORE_CONTEXT)}
              WHEN alloc_no_reg THEN {v._quoted(fv.NO_REGISTRATION)}
              WHEN imm_inval THEN {v._quoted(fv.INVALIDATED)} ELSE {v._quoted(fv.ODD_ORDER)} END AS signals,
         concat_ws(' and ', CASE WHEN norm_cycles > 0 THEN {_fill_sql(fv.NORMAL_CYCLES, n="norm_cycles")} END,
                            CASE WHEN serve_count >= 5 THEN {_fill_sql(fv.NORMAL_SERVES, n="serve_count")} END) AS normal,
         CASE WHEN lookup_misses >= 2 THEN {_fill_sql(fv.DETAIL_LOOKUP_MISSES, n="lookup_misses")}
              WHEN imm_inval THEN {_fill_sql(fv.DETAIL_ROLLBACK, a="first_registration", b="first_registration + 1")}
              WHEN alloc_no_reg THEN {_fill_sql(fv.DETAIL_NOT_COMPLETED, a="first_allocation")}
              WHEN len(failures) >= 2 THEN
                CASE WHEN last_fail_pos > first_fail_pos + 1
                     THEN {_fill_sql(fv.DETAIL_SPAN, a="first_fail_pos", b="last_fail_pos", n="length")} END
              WHEN norm_cycles = 0 AND pre_fail_normal = 0 AND length <= 3
                THEN {_fill_sql(fv.DETAIL_SHORT, n="length")} END AS detail
  FROM feats JOIN types ON anomaly_type = kind_no),
written AS (
  SELECT *, regexp_replace(concat_ws(' ', {opening},
              upper(detail[1]) || lower(detail[2:]) || '.',
              CASE time_insight {times} END), ' {{2,}}', ' ', 'g') AS full_text
  FROM turned),
cut AS (
  SELECT *, list_filter(string_split_regex(full_text, '\\.(?:\\s+|$)'), lambda s: trim(s) <> '') AS pieces FROM written),
told AS (
  SELECT block_id, anomaly_type, sequence, rotation, line_id,
         CASE WHEN len(pieces) > 5 THEN array_to_string(pieces[1:5], '. ') || '.' ELSE full_text END AS explanation
  FROM cut)"""


TOLD_SQL = told_sql(FEATURES_SQL)
DAILY_TOLD_SQL = told_sql(DAILY_SQL)


def _explained(spark: SparkSession, folder: str, daily: bool = False) -> DataFrame:
    rows = v.daily_traces(spark, folder) if daily else v.traces(spark, folder)
    return ex.explanations(tr.valid_traces(rows), tr.anomaly_types(spark), line_cells(), ["line_id"], store=True)


_SIGNALS_SQL = "array_to_string(list_transform({0}, lambda p: p.pos || ':' || p.event), ',')"


@EXPLAINING.add(
    f"""WITH {FEATURES_SQL}
SELECT block_id, length, len(failures) AS n_failures, len(context) AS n_context,
       {_SIGNALS_SQL.format("failures[1:3]")} AS failures, {_SIGNALS_SQL.format("context[1:3]")} AS context, norm_cycles, imm_inval, alloc_no_reg, serve_count, lookup_misses, first_fail_pos, last_fail_pos, pre_fail_normal, time_insight
FROM feats"""
)
def sequence_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = ex.sequence_features(tr.valid_traces(v.traces(spark, folder)))
    placed = lambda name: F.array_join(
        F.transform(name, lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), p["event"])), ","
    ).alias(name)
    plain = "n_failures n_context norm_cycles imm_inval alloc_no_reg serve_count lookup_misses first_fail_pos last_fail_pos pre_fail_normal time_insight"
    return rows.select("block_id", "length", placed("failures"), placed("context"), *plain.split())


_SESSIONS_AS_VALID = f"{v.SESSIONS_SQL}, valid AS (SELECT *, list_transform(gaps, lambda g: g::DOUBLE) AS time_interval FROM sessions)"
_FACT_NAMES = (
    "n_failures n_context norm_cycles imm_inval alloc_no_reg serve_count lookup_misses first_fail_pos "
    "last_fail_pos pre_fail_normal first_allocation first_registration time_insight"
)


@EXPLAINING.add(
    f"""WITH {features_sql(_SESSIONS_AS_VALID)}
SELECT block_id, length, {_SIGNALS_SQL.format("failures[1:3]")} AS failures, {_SIGNALS_SQL.format("context[1:3]")} AS context,
       len(failures) AS n_failures, len(context) AS n_context, norm_cycles, imm_inval, alloc_no_reg, serve_count, lookup_misses,
       first_fail_pos, last_fail_pos, pre_fail_normal, nullif(first_allocation, -1) AS first_allocation,
       nullif(first_registration, -1) AS first_registration, time_insight
FROM feats"""
)
def block_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts per block of the log, from sessions kept in parts of six events."""
    rows = bl.block_facts(materialize(v.session_parts(spark, folder, 6, with_gaps=True), "sessions"))
    placed = lambda name: F.array_join(
        F.transform(name, lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), p["event"])), ","
    ).alias(name)
    return rows.select("block_id", "length", placed("failures"), placed("context"), *_FACT_NAMES.split())


@EXPLAINING.add(
    f"""WITH {VALID_SQL},
spread AS (SELECT block_id, unnest(sequence) AS event, unnest(range(0, len(sequence))) AS pos FROM valid)
SELECT block_id, event, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM spread WHERE event <> 'E30' GROUP BY ALL"""
)
def position_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Places of every known event of a trace."""
    rows = tr.valid_traces(v.traces(spark, folder))
    placed = rows.select("block_id", F.explode(sq.position_map(F.col("sequence"), list(fv.EVENT_PHRASES))).alias("event", "at"))
    return placed.select("block_id", "event", F.array_join(F.col("at").cast("array<string>"), ",").alias("places"))


@EXPLAINING.add(
    f"""WITH {VALID_SQL},
uniq AS (SELECT *, list_filter(sequence, lambda e, i: list_position(sequence, e) = i) AS firsts FROM valid),
counted AS (
  SELECT *, list_sort(list_filter(list_transform(firsts, lambda e, i:
    {{'less': -len(list_filter(sequence, lambda o: o = e)), 'seen': i, 'event': e}}), lambda c: c.less < -1)) AS often FROM uniq)
SELECT block_id, array_to_string(firsts, ',') AS firsts,
       array_to_string(list_transform(often, lambda c: c.event || 'x' || -c.less), ',') AS often FROM counted"""
)
def sequence_repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.valid_traces(v.traces(spark, folder))
    often = F.transform(sq.repeated(F.col("sequence")), lambda r: F.concat(r["event"], F.lit("x"), r["n"].cast("string")))
    return rows.select(
        "block_id",
        F.array_join(sq.distinct_in_order(F.col("sequence")), ",").alias("firsts"),
        F.array_join(often, ",").alias("often"),
    )


@EXPLAINING.add(f"WITH {DAILY_TOLD_SQL} SELECT block_id, rotation FROM told")
def rotation_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.valid_traces(v.daily_traces(spark, folder))
    return ex.rotation(rows, line_cells(), ["line_id"], store=True).select("block_id", "rotation")


@EXPLAINING.add(f"WITH {TOLD_SQL} SELECT block_id, anomaly_type, array_to_string(sequence, ',') AS sequence, explanation FROM told")
def explanations(spark: SparkSession, folder: str) -> DataFrame:
    return _explained(spark, folder).select(
        "block_id", "anomaly_type", F.array_join("sequence", ",").alias("sequence"), "explanation"
    )


@EXPLAINING.add(f"WITH {DAILY_TOLD_SQL} SELECT block_id, anomaly_type, explanation FROM told")
def daily_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """Explanations of daily traces, where sequences repeat."""
    return _explained(spark, folder, daily=True).select("block_id", "anomaly_type", "explanation")


# -- quality ---------------------------------------------------------------

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
GATE_SQL = (
    f"CASE WHEN length(text) < {fv.MIN_TEXT_CHARS} THEN 'too short (' || length(text) || ' chars)' "
    + " ".join(
        f"WHEN starts_with(lower(text), {v._quoted(o)}) THEN {v._quoted(f'bad opener: {chr(39)}{o}{chr(39)}')}"
        for o in fv.BAD_OPENERS
    )
    + f" WHEN len(list_filter(string_split(text, '.'), lambda s: length(trim(s, {_BLANKS})) > {fv.MIN_SENTENCE_CHARS})) < 2"
    + " THEN 'fewer than 2 real sentences' ELSE 'ok' END"
)


@EXPLAINING.add(f"SELECT doc_id, {GATE_SQL} AS reason, ({GATE_SQL}) = 'ok' AS ok FROM documents")
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    return ql.gate(v.table(spark, folder, "documents"), "text").select("doc_id", "reason", "ok")


@EXPLAINING.add(f"WITH gated AS (SELECT {GATE_SQL} AS reason FROM documents) SELECT reason = 'ok' AS ok, reason, count(*) AS n FROM gated GROUP BY ALL")
def gate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ql.gate_counts(ql.gate(v.table(spark, folder, "documents"), "text"))


@EXPLAINING.add(
    f"WITH gated AS (SELECT {GATE_SQL} AS reason FROM documents) SELECT count(*) FILTER (reason = 'ok') AS accepted, count(*) FILTER (reason <> 'ok') AS rejected, count(*) FILTER (reason = 'ok') < 200 AS low_yield FROM gated"
)
def low_yield(spark: SparkSession, folder: str) -> DataFrame:
    return ql.low_yield(ql.gate(v.table(spark, folder, "documents"), "text"))


_SENTENCES_SQL = f"len(list_filter(string_split_regex(explanation, '\\.(?:\\s+|$)'), lambda s: trim(s) <> ''))"


@EXPLAINING.add(
    f"""WITH {TOLD_SQL}, counted AS (SELECT *, {_SENTENCES_SQL} AS n FROM told)
SELECT count(*) AS n_rows, count(DISTINCT array_to_string(sequence, ',')) AS distinct_sequences, count(DISTINCT explanation) AS distinct_texts,
       min(n) AS min_sentences, max(n) AS max_sentences, avg(n) AS avg_sentences, count(*) FILTER (n NOT BETWEEN 3 AND 5) AS out_of_range,
       count(*) FILTER (starts_with(explanation, 'Type ')) AS typed_openers,
       count(*) FILTER (contains(explanation, '- ') OR contains(explanation, '* ')) AS with_bullets,
       count(DISTINCT explanation) / greatest(count(*), 1) AS distinct_ratio
FROM counted"""
)
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return ql.report(_explained(spark, folder))


@EXPLAINING.add(f"WITH {TOLD_SQL} SELECT anomaly_type, count(*) AS n FROM told GROUP BY ALL")
def type_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return ql.breakdown(tr.valid_traces(v.traces(spark, folder)))


@EXPLAINING.add(f"WITH {DAILY_TOLD_SQL} SELECT {_SENTENCES_SQL} AS sentences, count(*) AS n FROM told GROUP BY ALL")
def sentence_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return ql.sentence_distribution(_explained(spark, folder, daily=True))


@EXPLAINING.add(
    f"WITH {v.SESSIONS_SQL}, said AS (SELECT 'saw ' || array_to_string(sequence, ', ') || ' and XE7 E8x' AS t FROM sessions) SELECT DISTINCT unnest(regexp_extract_all(t, '\\bE\\d+\\b')) AS code FROM said"
)
def leaked_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Event codes found in texts that name them."""
    said = F.concat(F.lit("saw "), F.array_join("sequence", ", "), F.lit(" and XE7 E8x"))
    return ql.leaked_codes(v.sessions(spark, folder).select(said.alias("explanation")))


@EXPLAINING.add(
    f"WITH {TOLD_SQL} SELECT anomaly_type, arg_min(explanation[1:250], line_id) AS sample FROM told GROUP BY anomaly_type"
)
def first_samples(spark: SparkSession, folder: str) -> DataFrame:
    return ql.first_per_type(_explained(spark, folder), F.col("line_id"))


@EXPLAINING.add(
    f"""WITH {DAILY_TOLD_SQL},
winner AS (SELECT anomaly_type, sequence FROM told WHERE rotation = 2 ORDER BY line_id LIMIT 1)
SELECT anomaly_type, rotation, arg_min(explanation[1:180], line_id) AS preview
FROM told SEMI JOIN winner USING (anomaly_type, sequence) WHERE rotation < 3 GROUP BY ALL"""
)
def rotation_sample(spark: SparkSession, folder: str) -> DataFrame:
    return ql.rotation_sample(_explained(spark, folder, daily=True), "line_id")
