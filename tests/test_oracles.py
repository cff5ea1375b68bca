"""Every registered query against its SQL twin on the given tables."""

import pytest

import oracle
from logweft.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


# Hook queries cross into Python workers on purpose; nothing else does.
HOOKS = ["scorer_hook", "generation_hook", "request_path"]
NOT_IN_PLANS = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name not in HOOKS:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [word for word in NOT_IN_PLANS if word in plan]
    got, columns = oracle.spark_rows(df)
    want, wanted = oracle.duck_rows(con, ORACLES[name])
    assert columns == wanted
    assert got == want


SESSION_QUERIES = sorted(name for name, sql in ORACLES.items() if "sessions AS (" in sql)


@pytest.mark.parametrize("name", SESSION_QUERIES)
def test_blocks_in_parts_change_no_answer(spark, data, con, name, monkeypatch):
    """With parts of three events every query on sessions still equals its SQL twin."""
    from logweft.operators import sessions

    monkeypatch.setattr(sessions, "PART_EVENTS", 3)
    assert oracle.spark_rows(QUERIES[name](spark, data)) == oracle.duck_rows(con, ORACLES[name])
