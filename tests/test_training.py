import hashlib
import pytest
from pyspark.sql import functions as F

from logweft import fixed_values as fv
from logweft.functions import render
from logweft.operators import curate as cu, packing as pk, quality as ql, samples as sm
from logweft.operators.ranking import line_cells
from logweft.plans import views as v

C = F.col


@pytest.mark.parametrize(
    "normal, anomalous, options, label, target, total",
    [
        (700, 100, {}, 1, 300, 50_000),
        (100, 700, {"min_samples": 10}, 0, 300, 1000),
        (100, 100, {"min_samples": 10}, 0, 100, 200),
        (700, 600, {"min_samples": 10}, 1, 600, 1300),
        (700, 100, {"max_samples": 500}, 1, 300, 500),
    ],
)
def test_balance_plan(normal, anomalous, options, label, target, total):
    plan = sm.balance_plan(normal, anomalous, **options)
    assert (plan.minority_label, plan.minority_target, plan.total) == (label, target, total)


def test_balance_plan_errors():
    with pytest.raises(ValueError):
        sm.balance_plan(700, 100, max_samples=1001)
    with pytest.raises(ValueError):
        sm.balance_plan(700, 0)


def test_balanced_sizes_are_exact(spark):
    rows = spark.range(800).select("id", (C("id") % 8 == 0).cast("int").alias("label"))
    for options in ({"min_samples": 2500}, {"min_samples": 10}, {"max_samples": 333}):
        plan = sm.plan_for(rows, **options)
        first = sm.balanced(rows, plan)
        assert first.count() == plan.total
        again = sm.balanced(rows.repartition(7), plan)
        key = lambda df: sorted(r.shuffle_key for r in df.select("shuffle_key").collect())
        assert key(first) == key(again)
        assert len(set(key(first))) == plan.total
    over = sm.oversample(rows, sm.plan_for(rows))
    assert over.filter("label = 1").count() == 300 and over.filter("label = 0").count() == 700


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(2, "size 7"), (1, "size 8"), (3, "other")], "line_id int, content string")
    got = sm.prepare(rows.withColumn("label", F.lit(0)), C("line_id")).orderBy("line_id").collect()
    assert [(r.line_id, r.content, r.messages) for r in got] == [(1, "size <*>", ["size <*>"]), (3, "other", ["other"])]


def test_message_join(one):
    assert one(sm.join_messages(F.split(C("t"), ",")), t="a,b") == "a ;-; b"
    assert one(sm.content_of_text(C("t")), t="['a, b', 'c']") == "a, b ;-; c"
    assert one(sm.content_of_text(C("t")), t="a,b") == "a ;-; b"
    assert one(sm.content_of_text(C("t")), t="[]") == ""


def test_pack_and_split_undo_each_other(spark):
    rows = spark.createDataFrame(
        [(i, [f"m{i}-{j}" for j in range(i % 5)], i % 2) for i in range(100)], "line_id bigint, messages array<string>, label int"
    )
    packed = pk.pack(pk.batches(rows, line_cells(), ["line_id"]), most=3).orderBy("batch_id").collect()
    assert [len(r.labels) for r in packed] == [16] * 6 + [4]
    frame = spark.createDataFrame(packed)
    lists = frame.select("batch_id", pk.split_at_starts(C("data"), C("starts")).alias("l")).orderBy("batch_id").collect()
    flat = [items for r in lists for items in r.l]
    assert flat == [[f"m{i}-{j}" for j in range(min(i % 5, 3))] for i in range(100)]
    assert packed[0].labels[:3] == ["normal", "anomalous", "normal"] and packed[0].starts[:3] == [0, 1, 3]
    right = pk.pad_batches(frame, "").orderBy("batch_id").first()
    left = pk.pad_batches(frame, "", left=True).orderBy("batch_id").first()
    assert right.padded[2] == ["m2-0", "m2-1", ""] and right.mask[2] == [1, 1, 0]
    assert left.padded[2] == ["", "m2-0", "m2-1"] and left.mask[2] == [0, 1, 1]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("short", "too short (5 chars)"),
        ("Here is " + "x" * 200, "bad opener: 'here is'"),
        ("SURE, " + "x" * 200, "bad opener: 'sure,'"),
        ("x" * 200, "fewer than 2 real sentences"),
        ("x" * 100 + "." + "y" * 100, "ok"),
        ("x" * 180 + "." + "y" * 20, "fewer than 2 real sentences"),
    ],
)
def test_gate(one, text, reason):
    assert one(ql.gate_reason(C("t")), t=text) == reason


def test_missing_answer_is_rejected(spark):
    row = ql.gate(spark.createDataFrame([(None,)], "t string"), "t").first()
    assert (row.ok, row.reason) == (False, fv.CALL_FAILED)


def test_split_is_exact_and_stable(spark):
    rows = spark.range(1234).select(C("id").cast("string").alias("k"))
    split = cu.split_rows(rows, "k")
    assert split.filter("split = 'train'").count() == int(1234 * 0.9)
    assert sorted(r.position for r in split.collect()) == list(range(1234))
    again = {(r.k, r.split) for r in cu.split_rows(rows.repartition(9), "k").collect()}
    assert again == {(r.k, r.split) for r in split.collect()}


def test_samples_are_the_least_hashes(spark):
    rows = spark.range(3000).select(C("id").cast("string").alias("block_id"))
    small = {r.block_id for r in cu.sample_rows(rows, 700).collect()}
    least = sorted((hashlib.md5(f"{fv.SAMPLE_SEED}|{i}".encode()).hexdigest(), str(i)) for i in range(3000))[:700]
    assert small == {name for _, name in least}
    assert {r.block_id for r in cu.sample_rows(rows.limit(5), 700).collect()} == {str(i) for i in range(5)}


def test_processed_ids_and_remaining(spark):
    chat = "block_id string, messages array<struct<role:string,content:string>>"
    done = spark.createDataFrame(
        [("blk_1", None), (None, [("system", "s"), ("user", "Hi\nBlock: blk_2 \nBlock: blk_9")]), (None, [("system", "s")])], chat
    )
    ids = cu.processed_ids(done)
    assert {r.block_id for r in ids.collect()} == {"blk_1", "blk_2"}
    sample = spark.createDataFrame([("blk_1",), ("blk_2",), ("blk_3",)], "block_id string")
    assert [r.block_id for r in cu.remaining(sample, ids).collect()] == ["blk_3"]


def test_recovered_type(one):
    assert one(cu.recovered_type(C("t")), t="Block: b\nAnomaly Type: 21 \nx") == "21"
    assert one(cu.recovered_type(C("t")), t="Block: b\nAnomaly Type:\nx") == ""
    assert one(cu.recovered_type(C("t")), t="no such line") == "unknown"


def test_first_file_wins(spark):
    a = spark.createDataFrame([(5, "x"), (6, "y")], "at int, text string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "at int, text string")
    got = {(r.text, r.at) for r in cu.first_of_each_text(cu.union_in_order(a, b, "at"), "text").collect()}
    assert got == {("x", 5), ("y", 6), ("z", 2)}


def test_worked_example_message(spark):
    row = spark.createDataFrame(
        [("blk_-1608999687919862906", 5, "E5 E22 E5 E11 E9 E11 E9 E26 E26 E23 E21 E20".split(), 3802.0)],
        "block_id string, anomaly_type int, sequence array<string>, latency double",
    )
    user = row.select(render.sampled_chat(F.lit("a")).alias("m")).first().m[1].content
    assert user == (
        "Block: blk_-1608999687919862906\nAnomaly Type: 5\nSequence: ['E5', 'E22', 'E5', 'E11', 'E9', 'E11', 'E9', 'E26', 'E26', 'E23', 'E21', 'E20']\n"
        "Sequence Length: 12\nLatency: 1.1 hours"
    )
    other = row.select(render.training_chat(F.lit("a")).alias("m")).first().m
    assert other[1].content.endswith("Sequence Length: 12") and [m.role for m in other] == ["system", "user", "assistant"]
    assert row.select(render.text_list_length(F.lit("E5,E22")).alias("n")).first().n == 2


def test_leaks_and_marker(one, spark):
    rows = spark.createDataFrame([("saw E7, E22 and XE9 or E5x",)], "explanation string")
    assert {r.code for r in ql.leaked_codes(rows).collect()} == {"E7", "E22"}
    assert one(render.after_marker(C("t")), t="p### Explanation:\nq### Explanation:\n said \n") == "said"
    assert one(render.after_marker(C("t")), t=" all ") == "all"
