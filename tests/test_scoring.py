import pytest
from pyspark.sql import functions as F

from logweft import fixed_values as fv
from logweft.operators import dashboard as db, scoring as sc
from logweft.operators.ranking import line_cells

C = F.col


@pytest.mark.parametrize(
    "events, verdict",
    [
        ("E5 E22 E26 E11 E9", "normal"),
        ("E5 E7", "anomalous"),
        ("E22 E5", "anomalous"),
        ("E22 E26 E23", "anomalous"),
        ("E22 E26 E3 E23", "normal"),
    ],
)
def test_rule_verdict(one, events, verdict):
    assert one(sc.rule_verdict(F.split(C("t"), " ")), t=events) == verdict


@pytest.mark.parametrize(
    "reply, status, explanation",
    [
        ('{"status": "Normal", "explanation": "fine"}', "Normal", "fine"),
        ('```json\n{"status": "Anomalous", "explanation": "bad"}\n```', "Anomalous", "bad"),
        ('{"status": "N"} tail', "Unknown", '{"status": "N"} tail'),
        ('{"status": "N", "explanation": "x"} tail', "Unknown", '{"status": "N", "explanation": "x"} tail'),
        ('{"status": "N"}', "Unknown", '{"status": "N"}'),
        ("[1, 2]", "Unknown", "[1, 2]"),
        ("", "Unknown", ""),
    ],
)
def test_reply(one, reply, status, explanation):
    got = one(sc.parsed_reply(C("t")), t=reply)
    assert (got.status, got.explanation) == (status, explanation)


def test_prediction(one):
    assert one(sc.prediction(C("t")), t="It is ANOMALOUS.") == 1
    assert one(sc.prediction(C("t")), t="normal") == 0


def test_generator_retries_then_gives_up(spark, tmp_path):
    marks = str(tmp_path)

    def flaky(prompt):
        import os

        path = os.path.join(marks, prompt)
        tries = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if prompt == "never" or tries < 2:
            raise RuntimeError("busy")
        return f"  answer to {prompt} "

    rows = spark.createDataFrame([("second",), ("never",)], "prompt string")
    got = {r.prompt: r.explanation for r in sc.generate(rows, flaky, wait=0.0).collect()}
    assert got == {"second": "answer to second", "never": None}


@pytest.mark.parametrize(
    "status, latency, events, score, level",
    [
        ("Normal", 30.0, "E1", 87, "Low"),
        ("Anomalous", 25.0, "E22 E11", 66, "Critical"),
        ("Anomalous", 20.0, "E22", 69, "High"),
        ("Anomalous", 15.0, "E5", 82, "Medium"),
        ("Anomalous", 10.0, "E5", 82, "Low"),
        ("Unknown", 12.0, "E11", 92, "Medium"),
    ],
)
def test_score_and_severity(one, status, latency, events, score, level):
    items = F.split(C("e"), " ")
    assert one(db.confidence(C("s"), C("l"), items), s=status, l=latency, e=events) == score
    assert one(db.severity(C("s"), C("l")), s=status, l=latency) == level


def test_recommendations(one):
    items = F.split(C("e"), " ")
    assert one(db.recommendations(C("s"), items), s="Normal", e="E5") == fv.NORMAL_ACTIONS
    assert one(db.recommendations(C("s"), items), s="Anomalous", e="E22 E5") == [
        "Check DataNode availability", "Inspect replication pipeline", "Review recent cluster logs"]
    assert one(db.recommendations(C("s"), items), s="Unknown", e="E1") == ["Review recent cluster logs"]


def history(spark):
    rows = [(1, "blk_1", "Normal", 2.0), (2, "blk_2", "Anomalous", 4.0), (3, "blk_3", "Unknown", 9.0)]
    return spark.createDataFrame(rows, "id bigint, block_id string, status string, latency double").withColumn("explanation", F.lit("x" * 200))


def test_views(spark):
    rows = history(spark)
    assert tuple(db.stats(rows).first()) == (3, 1, 1, 5.0)
    assert tuple(db.stats(rows.limit(0)).first()) == (0, 0, 0, 0.0)
    assert {(r.status, r.n, r.percent) for r in db.health_share(rows).collect()} == {("Normal", 1, 50), ("Anomalous", 1, 50)}
    running = db.running_stats(rows, line_cells("id"), ["id"]).orderBy("id").collect()
    assert [(r.total, r.anomalies, r.healthy, r.avg_latency) for r in running] == [(1, 0, 1, 2.0), (2, 1, 1, 3.0), (3, 1, 1, 5.0)]
    assert [r.id for r in db.search(rows, "ANOM").collect()] == [2]
    assert [r.id for r in db.sort_history(rows).collect()] == [3, 2, 1]
    found = db.alerts(rows)
    assert [(r.id, len(r.preview)) for r in found.collect()] == [(2, 141)]
    assert db.dismiss(found, spark.createDataFrame([(2,)], "id bigint")).count() == 0


def test_two_decimals(one):
    assert one(db.two_decimals(C("x")), x=2.345) == "2.35"
    assert one(db.two_decimals(C("x")), x=7.0) == "7.00"
