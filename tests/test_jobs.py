import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from logweft.operators.templates import vocabulary
from logweft import fixed_values as fv, schemas
from logweft.operators import dashboard as db
from logweft.plans import jobs, views as v
from logweft.sources import tables


def test_detect_and_explain(spark, tmp_path, data):
    v.log_lines(spark, data).orderBy("line_id").select("value").coalesce(1).write.text(str(tmp_path / "log"))
    out = str(tmp_path / "out")
    score = lambda texts: ["ANOMALOUS" if "exception" in t.lower() else "normal" for t in texts]
    counts = jobs.detect_and_explain(
        spark, str(tmp_path / "log"), v.templates(), out, score, lambda p: p + " told you ", explain_limit=4)
    assert counts["total"] == counts["blank"] + counts["no_block"] + counts["unmatched"] + counts["matched"]
    assert counts["sessions"] == v.sessions(spark, data).count() and 0 < counts["anomalies"] < counts["sessions"]
    told = spark.read.json(f"{out}/explanations")
    assert told.count() == 4 and {r.explanation for r in told.collect()} == {"told you"}
    assert spark.read.csv(f"{out}/contents", header=True).columns == ["Content", "Label"]


def test_every_anomaly_is_explained_by_default(spark, tmp_path, data):
    v.log_lines(spark, data).orderBy("line_id").select("value").coalesce(1).write.text(str(tmp_path / "log"))
    out = str(tmp_path / "out")
    counts = jobs.detect_and_explain(spark, str(tmp_path / "log"), v.templates(), out)
    told = spark.read.json(f"{out}/explanations").collect()
    assert len(told) == counts["anomalies"] > 10
    assert all(r.explanation.endswith(".") and len(r.explanation) > 20 for r in told)


def trace_file(tmp_path):
    path = tmp_path / "traces.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow("BlockId Label Type Features TimeInterval Latency".split())
        for i in range(40):
            w.writerow([f"blk_{i}", "Fail", 5 if i % 2 else "", f"[E5,E22,E26,E{i % 9 + 1}]", "[0.0, 1.0, 70.0, 2.0]", "73.0"])
        w.writerow(["blk_x", "Fail", "8", "[E5]", "[]", ""])
    return str(path)


def test_explain_traces(spark, tmp_path):
    report = jobs.explain_traces(spark, trace_file(tmp_path), str(tmp_path / "out")).first()
    assert report.n_rows == 20 and report.out_of_range == 0 and report.typed_openers == 0
    skipped = {r.skip_reason: r.n for r in spark.read.json(str(tmp_path / "out" / "skipped")).collect()}
    assert skipped == {"unparseable type: ": 20, "invalid type: 8": 1}
    part = lambda name: spark.read.json(str(tmp_path / "out" / name)).collect()
    assert sum(r.n for r in part("types")) == sum(r.n for r in part("sentences")) == 20
    assert len(part("first_skipped")) == 10 and {r.skip_reason for r in part("first_skipped")} <= set(skipped)
    assert {r.anomaly_type for r in part("first_samples")} == {r.anomaly_type for r in part("types")}
    assert {r.rotation for r in part("rotation_samples")} <= {0, 1, 2}
    assert spark.read.schema("code string").json(str(tmp_path / "out" / "leaked_codes")).count() == 0
    told = spark.read.json(str(tmp_path / "out" / "explanations_json"))
    assert sorted(told.columns) == ["anomaly_type", "block_id", "explanation", "sequence"]


def test_sampled_generation_resumes(spark, tmp_path):
    accepted, rejected = str(tmp_path / "ok"), str(tmp_path / "no")
    traces = trace_file(tmp_path)

    def answer(prompt):
        if "-> E2\n" in prompt or prompt.count("E2 appears"):
            raise RuntimeError("down")
        if "-> E4" in prompt:
            return "too short"
        return "The write pipeline opened as usual and one replica was registered. " * 3 + prompt[-20:]

    run = lambda n: jobs.sampled_generation(
        spark, traces, vocabulary(fv.TEMPLATES_30), answer, accepted, rejected, sample_size=n, wait=0.0).first()
    first = run(700)
    assert first.accepted + first.rejected == 9 and first.accepted >= 6 and first.low_yield
    again = run(700)
    assert again.accepted + again.rejected == 0
    done = tables.read_json_lines(spark, accepted, schemas.CHAT)
    assert done.count() == first.accepted
    bad = tables.read_json_lines(spark, rejected, schemas.REJECTS)
    assert bad.filter("messages IS NULL").first().reason == fv.CALL_FAILED
    assert bad.filter("messages IS NOT NULL").first()._reject_reason == "too short (9 chars)"


def chat(block, answer, kind="5"):
    user = f"Block: {block}\nAnomaly Type: {kind}\nx"
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in (("system", "s"), ("user", user), ("assistant", answer))]})


def test_combine_and_split(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text("\n".join(chat(f"a{i}", f"t{i}") for i in range(30)) + "\n\n{broken\n")
    (tmp_path / "2.jsonl").write_text("\n".join(chat(f"b{i}", f"t{i}", "7") for i in range(20, 50)) + "\n")
    out = str(tmp_path / "out")
    counts = jobs.combine_and_split(spark, str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl"), out)
    assert counts == {"total": 60, "unique": 50, "removed": 10}
    train, val = (spark.read.schema(schemas.CHAT).json(f"{out}/{n}") for n in ("train", "val"))
    assert (train.count(), val.count()) == (45, 5)
    kinds = {r.kind: r.n for r in jobs.type_distribution(train.union(val)).collect()}
    assert kinds == {"5": 30, "7": 20}


def test_missing_file_is_empty(spark, tmp_path):
    assert tables.read_json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_training_records(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps([{"block_id": "b", "anomaly_type": 5, "sequence": ["E5", "E2"], "explanation": "why — so"}], indent=2))
    jobs.training_records(spark, str(path), str(tmp_path / "out"))
    row = spark.read.schema(schemas.CHAT).json(str(tmp_path / "out")).first()
    assert row.messages[1].content == "Block: b\nAnomaly Type: 5\nSequence: [E5, E2]\nSequence Length: 2"
    assert row.messages[2].content == "why — so"


def test_requests(spark):
    rows = spark.createDataFrame(
        [("a", ["x"], ["E7"], 3.0), ("b", ["y"], ["E5"], 1.0)], schemas.REQUESTS)
    got = {r.block_id: (r.status, r.explanation) for r in jobs.analyze_requests(rows, None, lambda p: p + "bad disk").collect()}
    assert got == {"a": ("Anomalous", "bad disk"), "b": ("Normal", fv.NORMAL_REPLY)}


def counting(folder, answer):
    """A hook that leaves a line per call in a file of its process."""

    def hook(given):
        with open(f"{folder}/{os.getpid()}", "a") as calls:
            calls.writelines("x\n" for _ in (given if isinstance(given, list) else [given]))
        return answer(given)

    return hook


def calls(folder):
    return sum(len(path.read_text().splitlines()) for path in folder.iterdir())


@pytest.mark.parametrize("streamed", [False, True])
def test_requests_reach_each_hook_once(spark, tmp_path, streamed):
    for name in ("scored", "told", "in"):
        (tmp_path / name).mkdir()
    rows = spark.createDataFrame(
        [(f"b{i}", ["bad" if i % 4 == 0 else "good"], ["E5"], 1.0) for i in range(20)], schemas.REQUESTS)
    scorer = counting(tmp_path / "scored", lambda texts: ["anomalous" if "bad" in t else "normal" for t in texts])
    told = counting(tmp_path / "told", lambda prompt: prompt + "why")
    if streamed:
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = jobs.analyze_requests(rows, scorer, told).writeStream.format("memory").queryName("once").start()
        query.processAllAvailable()
        query.stop()
        got = spark.table("once").collect()
    else:
        got = jobs.analyze_requests(rows, scorer, told).collect()
    assert (calls(tmp_path / "scored"), calls(tmp_path / "told")) == (20, 5)
    assert sum(r.status == "Anomalous" and r.explanation == "why" for r in got) == 5 and len(got) == 20


def test_label_windows(spark, tmp_path):
    labels = tmp_path / "l.csv"
    labels.write_text("BlockId,Label\nblk_0,Anomaly\nblk_1,Normal\nblk_99,Anomaly\n")
    rows = jobs.label_windows(spark, trace_file(tmp_path), str(labels), v.templates(), window=3, stride=1)
    assert rows.count() == 4 and rows.agg(F.sum("label")).first()[0] == 2
    assert rows.filter("block_id = 'blk_0' and win_ix = 0").first().window_text.count("[SEP]") == 2


def test_header_mismatch_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("BlockId,Type,Label,Features,TimeInterval,Latency\na,1,Fail,[E5],[],\n")
    with pytest.raises(Exception):
        tables.read_traces(spark, str(path)).collect()


def test_a_log_without_matches_is_named(spark, tmp_path):
    (tmp_path / "empty.log").write_text("\n\nno block here\n")
    with pytest.raises(ValueError, match="no matched lines"):
        jobs.detect_and_explain(spark, str(tmp_path / "empty.log"), vocabulary(fv.TEMPLATES_30), str(tmp_path / "out"))


def test_open_alerts_come_newest_first(spark):
    rows = [(i, f"b{i}", "Anomalous", "x" * 200) for i in (3, 9, 1, 7, 5)]
    history = spark.createDataFrame(rows, "id bigint, block_id string, status string, explanation string")
    gone = spark.createDataFrame([(7,)], "id bigint")
    open_ones = db.newest_first(db.dismiss(db.alerts(history), gone)).collect()
    assert [r.id for r in open_ones] == [9, 5, 3, 1]
    plan = db.dismiss(db.alerts(history), gone)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan
