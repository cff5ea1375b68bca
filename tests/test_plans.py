"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from logweft.functions import text as tx
from logweft.operators import curate as cu, dashboard as db, lines as ln, quality as ql, samples as sm, sessions as ss, traces as tr
from logweft.plans import parsing, views as v
from logweft.session import materialize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan_of(df)))


@pytest.fixture(scope="module")
def stored(spark, data):
    return materialize(v.occurrences(spark, data), "occurrences")


def test_sessions_shuffle_once(stored):
    assert exchanges(ss.sessions(stored, v.templates(), with_text=True, with_gaps=True)) == 1
    assert exchanges(ss.event_matrix(stored, v.templates())) == 1


def test_the_flagship_query_shuffles_once(spark, data):
    assert exchanges(parsing.block_sessions(spark, data)) == 1


def test_parsing_is_narrow_and_runs_each_pattern_once(spark, data):
    lines = spark.read.parquet(f"{data}/events.parquet")
    plan = plan_of(ln.events(v.lines_of(lines), v.templates()))
    assert "Exchange" not in plan
    assert plan.count("allocateblock") == 2  # its probe word and its pattern
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_trace_and_text_operators_are_narrow(spark, data, stored):
    rows = ss.sessions(stored, v.templates(), with_gaps=True)
    traces = materialize(v.traces_of(rows), "traces")
    for df in (
        tr.valid_traces(traces),
        cu.usable(tr.sampled_traces(traces)),
        tr.window_rows(tr.sampled_traces(traces).withColumnRenamed("sequence", "events"), v.templates()),
        ql.gate(v.table(spark, data, "documents"), "text"),
        sm.prepare(v.table(spark, data, "documents").select(F.col("text").alias("content"))),
    ):
        assert "Exchange" not in plan_of(df)


def test_top_k_is_cut_before_the_shuffle(spark, data):
    lines = v.lines_of(spark.read.parquet(f"{data}/events.parquet"))
    named = lines.select("line_id", F.col("value").alias("text"), tx.block_id(F.col("value")).alias("b"))
    plan = plan_of(db.recent_context(named, ["b"], "line_id"))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") or plan.count("WindowGroupLimit") == 2


def test_a_sample_is_ranked_in_cells(spark, data):
    sample = plan_of(cu.sample_rows(tr.sampled_traces(v.traces(spark, data)), 5))
    assert "TakeOrderedAndProject" not in sample and "rangepartitioning" not in sample


def test_filters_reach_the_scan(spark, data):
    rows = v.table(spark, data, "documents").filter("n_chars > 500").select("doc_id")
    plan = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,500)]" in plan
