"""JSON arrays in splits, calls through a ledger, sparse counts, stored sketches."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from logweft import schemas
from logweft.operators import calls, lines as ln, scoring as sc, sessions as ss
from logweft.plans import views as v
from logweft.sources import json_array, tables

SCHEMA = "id int, text string, sub struct<a:array<int>,b:string>"


def odd_text(rnd):
    return "".join(rnd.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "\U0001f600", "a", " ", '"}', "\\}"]) for _ in range(rnd.randint(0, 30)))


@pytest.mark.parametrize("indent", [None, 2])
def test_array_in_splits_equals_one_task(spark, tmp_path, indent):
    rnd = random.Random(indent or 0)
    rows = [{"id": i, "text": odd_text(rnd), "sub": {"a": [1] * rnd.randint(0, 3), "b": odd_text(rnd)}} for i in range(300)]
    path = tmp_path / "array.json"
    path.write_text(" \n" + json.dumps(rows, indent=indent) + "\n")
    size = path.stat().st_size // 8 + 1
    settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1, "spark.sql.files.minPartitionNum": 8}
    for key, value in settings.items():
        spark.conf.set(key, str(value))
    try:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() >= 8
        got = json_array.read_json_array(spark, str(path), spark.createDataFrame([], SCHEMA).schema).orderBy("line_id").collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    plain = spark.read.schema(SCHEMA).json(str(path), multiLine=True).collect()
    assert [(r.id, r.text, r.sub) for r in got] == [(r.id, r.text, r.sub) for r in plain]
    assert [r.text for r in got] == [r["text"] for r in rows] and [r.line_id for r in got] == list(range(300))


def test_several_and_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text('[{"id": 1, "text": "]"}]')
    (tmp_path / "c.json").write_text('[\n{"id": 2}\n,\n{"id": 3, "text": null}\n]\n')
    rows = json_array.read_json_array(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema)
    assert sorted((r.id, r.text, r.line_id) for r in rows.collect()) == [(1, "]", 0), (2, None, 0), (3, None, 1)]
    told = [{"block_id": "b", "anomaly_type": 1, "sequence": ["E1"], "explanation": "x"}]
    (tmp_path / "d.json").write_text(json.dumps(told))
    one = json_array.read_json_array(spark, str(tmp_path / "d.json"), schemas.EXPLANATIONS).drop("file_key").collect()
    assert one == tables.read_explanations(spark, str(tmp_path / "d.json")).drop("file_key").collect()


# -- calls -------------------------------------------------------------------


def test_a_job_that_died_makes_no_call_twice(spark, tmp_path):
    ledger, log = f"file://{tmp_path}/ledger", tmp_path / "log"
    log.mkdir()

    def generator(prompt, dies):
        n = len(os.listdir(log))
        (log / f"{prompt}-{n}-{time.monotonic_ns()}").touch()
        if dies and n > 12:
            raise SystemExit("the task is killed")
        return f" answer to {prompt} "

    rows = spark.range(40).select(F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("prompt")).coalesce(1)
    with pytest.raises(Exception):
        sc.generate(rows, lambda p: generator(p, True), ledger=ledger).collect()
    done = {n.partition("-")[0] for n in os.listdir(log)}
    assert 10 < len(done) < 30
    kept = sum(calls.Ledger(ledger).get(p) is not None for p in done)
    told = sc.generate(rows, lambda p: generator(p, False), ledger=ledger).collect()
    assert [r.explanation for r in told] == [f"answer to {r.prompt}" for r in told] and len(told) == 40
    made = [n.partition("-")[0] for n in os.listdir(log)]
    assert len(set(made)) == 30 and len(made) == 30 + len(done) - kept and len(done) - kept <= 1


def test_ten_calls_are_under_way_at_once():
    lock, now, most = threading.Lock(), 0, 0
    gate = threading.Barrier(10, timeout=30)

    def generator(prompt):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        gate.wait()
        with lock:
            now -= 1
        return prompt.upper()

    caller = calls.Caller(generator, 1, 0.0, 10, 0.0, None)
    assert caller.answers([f"a{i}" for i in range(40)] + [None]) == [f"A{i}" for i in range(40)] + [None]
    assert most == 10


def test_calls_keep_their_pace_and_failures_are_tried_again(tmp_path):
    starts, failed = [], set()

    def generator(prompt):
        starts.append(time.monotonic())
        if prompt == "never" or (prompt == "once" and prompt not in failed):
            failed.add(prompt)
            raise RuntimeError("down")
        return prompt

    caller = calls.Caller(generator, 2, 0.0, 4, 50.0, str(tmp_path / "ledger"))
    assert caller.answers(["a", "once", "never", "a", "b"]) == ["a", "once", None, "a", "b"]
    assert len(starts) == 6 and sorted(starts)[-1] - sorted(starts)[0] >= 5 / 50 * 0.9
    assert calls.Ledger(str(tmp_path / "ledger")).get("never") is None


# -- counts ------------------------------------------------------------------


def test_sparse_rows_equal_the_matrix(spark, data):
    found = v.occurrences(spark, data)
    wide = {r["block_id"]: r for r in ss.event_matrix(found, v.templates()).collect()}
    names = [t.event_id for t in v.templates()]
    rows = ss.sparse_event_matrix(found).collect()
    assert len(rows) == len(wide)
    for r in rows:
        want = [(i, wide[r.block_id][n]) for i, n in enumerate(names) if wide[r.block_id][n]]
        assert list(zip(r.ords, r.counts)) == want
    many = spark.range(60_000).select((F.col("id") % 3).alias("block_id"), (F.col("id") % 20_000).alias("ord"))
    assert [len(r.ords) for r in ss.sparse_event_matrix(many).collect()] == [20_000] * 3


def test_sketches_of_days_merge_within_their_error(spark):
    rows = spark.range(200_000).select(
        F.concat(F.lit("b"), (F.col("id") % 50_000).cast("string")).alias("block_id"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 7))").alias("ts"),
    )
    stored = ln.daily_counters(rows)
    got = ln.counters_between(stored, F.lit("2024-01-02").cast("date"), F.lit("2024-01-04").cast("date")).first()
    exact = rows.filter("id % 7 BETWEEN 1 AND 3").select("block_id").distinct().count()
    assert got.n_events == rows.filter("id % 7 BETWEEN 1 AND 3").count()
    assert abs(got.unique_blocks - exact) <= ln.SKETCH_ERROR * exact
    none = ln.counters_between(stored, F.lit("2023-01-02").cast("date"), F.lit("2023-01-04").cast("date")).first()
    assert tuple(none) == (0, 0)
