import hashlib

import pytest
from pyspark.sql import functions as F

from logweft.functions import sequences as sq
from logweft.operators import explain as ex, traces as tr
from logweft.operators.ranking import line_cells, rank_rows, running_totals
from logweft.plans import views as v

C = F.col


def traces(spark, rows):
    """rows: (block, type, sequence, gaps, latency)"""
    data = [(b, t, s, g, l, i) for i, (b, t, s, g, l) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "block_id string, anomaly_type int, sequence array<string>, time_interval array<double>, latency double, line_id bigint",
    )


def facts(spark, sequence, gaps=(), latency=100.0):
    return ex.sequence_features(traces(spark, [("b", 0, list(sequence), list(gaps), latency)])).first()


def test_short_sequences_are_safe(spark):
    for sequence in ([], ["E11"]):
        row = facts(spark, sequence)
        assert (row.norm_cycles, row.imm_inval, row.first_fail_pos, row.pre_fail_normal) == (0, False, None, 0)


def test_facts(spark):
    row = facts(spark, "E5 E22 E11 E9 E11 E9 E3 E7 E26 E23 E20 E20".split())
    assert (row.norm_cycles, row.imm_inval, row.alloc_no_reg, row.serve_count, row.lookup_misses) == (2, True, False, 1, 2)
    assert (row.first_fail_pos, row.last_fail_pos, row.pre_fail_normal) == (7, 11, 5)
    assert [(f.pos, f.event) for f in row.failures] == [(7, "E7"), (10, "E20"), (11, "E20")]
    assert (row.first_allocation, row.first_registration, row.length) == (1, 8, 12)
    assert facts(spark, ["E22"]).alloc_no_reg is True


@pytest.mark.parametrize(
    "sequence, gaps, latency, insight",
    [
        (["E5"], [], 0.0, "very_short"),
        (["E5"] * 4, [0, 0, 0, 0], 4000.0, "very_long"),
        (["E5"] * 3, [0, 40, 0], 4000.0, "moderate_gap"),
        (["E5", "E21"], [0, 61], 100.0, "long_gap_before_cleanup"),
        (["E5", "E21"], [0, 60], 100.0, "moderate_gap"),
        (["E21", "E5"], [0, 121], 100.0, "long_gap"),
        (["E5", "E5", "E21"], [0, 121], None, "long_gap"),
        (["E5", "E21"], [61], 100.0, None),
        (["E5", "E5"], [0, 30], None, None),
    ],
)
def test_time_insight(spark, sequence, gaps, latency, insight):
    assert facts(spark, sequence, [float(g) for g in gaps], latency).time_insight == insight


def test_positions_and_repeats(one):
    events = F.split(C("t"), " ")
    text = "E2 E5 E2 E9 E5 E2"
    assert one(sq.positions(events, "E5"), t=text) == [1, 4]
    assert one(sq.position_map(events, ["E5", "E2", "E7"]), t=text) == {"E5": [1, 4], "E2": [0, 2, 5]}
    assert one(sq.distinct_in_order(events), t=text) == ["E2", "E5", "E9"]
    assert [(r.event, r.n) for r in one(sq.repeated(events), t=text)] == [("E2", 3), ("E5", 2)]
    assert [(r.event, r.n) for r in one(sq.repeated(events), t="E9 E5 E5 E9")] == [("E9", 2), ("E5", 2)]
    assert one(sq.fingerprint(events), t="E5 E22") == hashlib.md5(b"E5,E22").hexdigest()
    assert one(sq.length_between(events, 3, 6), t=text) is True


@pytest.mark.parametrize("n, count", [(1, 1), (19, 1), (20, 1), (25, 1), (30, 2), (45, 3)])
def test_windows(spark, n, count):
    events = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
    got = spark.range(1).select(tr.windows(events).alias("w")).first().w
    items = [str(i) for i in range(1, n + 1)]
    assert got == [items[i : i + 20] for i in range(0, max(1, n - 20 + 1), 10)]
    assert len(got) == count


def test_rotation_counts_same_type_and_sequence(spark):
    rows = [("b", 5, ["E5"], [], 1.0)] * 6 + [("c", 3, ["E5"], [], 1.0), ("d", 5, ["E6"], [], 1.0)]
    got = ex.rotation(traces(spark, rows), line_cells(), ["line_id"]).orderBy("line_id").collect()
    assert [r.rotation for r in got] == [0, 1, 2, 3, 4, 0, 0, 0]


def test_rank_over_many_cells_with_one_big_group(spark):
    rows = spark.range(0, 300_000, 1, 8).select(
        (F.col("id") * 7919 % 300_007).alias("line_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k")
    )
    ranked = rank_rows(rows, "pos", line_cells(), ["line_id"], ["k"])
    from pyspark.sql import Window

    plain = F.row_number().over(Window.partitionBy("k").orderBy("line_id")) - 1
    assert ranked.withColumn("want", plain).filter("pos <> want").count() == 0
    assert ranked.count() == 300_000


def test_running_totals_without_keys(spark):
    rows = spark.range(200_000).select(F.col("id").alias("line_id"), (F.col("id") % 10).alias("x"))
    got = running_totals(rows, [], line_cells(), ["line_id"], {"s": F.col("x")})
    assert got.filter((F.col("line_id") == 199_999)).first().s == 900_000
    assert got.filter((F.col("line_id") == 70_004)).first().s == 315_010


TYPES = [0, 1, 3, 4, 5, 7, 9, 16, 21, 31]


def explained(spark, rows):
    told = ex.explanations(traces(spark, rows), tr.anomaly_types(spark), line_cells(), ["line_id"])
    return [r.explanation for r in told.orderBy("line_id").collect()]


def test_explanation_texts(spark):
    base = ("b", 5, "E5 E22 E26 E23 E20".split(), [], 3.5)
    texts = explained(spark, [base] * 6 + [("c", 3, ["E22", "E5"], [0.0, 10.0], 50.0)])
    assert texts[0] == texts[5]
    assert texts[0].startswith("The failure is signaled by block metadata not found in DataNode volume map at position 4.")
    assert texts[0].endswith(
        "Replica registration at position 2 was immediately rolled back by invalidation at position 3. "
        "The entire trace completed in only 3.5s, indicating the failure occurred almost immediately after pipeline setup."
    )
    assert texts[1].startswith("The root cause traces to the NameNode accepted replicas then invalidated them")
    assert texts[2].startswith("From a cluster perspective, wasted write I/O")
    assert "Recovery implications: wasted write I/O" in texts[3]
    assert texts[4].startswith("From a monitoring standpoint, this anomaly is flagged by block metadata")
    assert "block allocation with no subsequent replica registration" in texts[6]
    assert "Block allocation at position 0 was never completed with a replica registration." in texts[6]


def test_explanation_branches(spark):
    many = ("b", 9, ["E7", "E8", "E10", "E12", "E13"], [], 100.0)
    four = ("b", 9, ["E7", "E8", "E10", "E12"], [], 100.0)
    context = ("b", 0, ["E6", "E16", "E18", "E25", "E4"], [], 100.0)
    normal = ("b", 7, ["E11", "E9"] * 2 + ["E3"] * 5 + ["E14"], [], 100.0)
    side = ("b", 9, ["E7", "E8"], [], 100.0)
    odd = ("b", 1, ["E2", "E2", "E2", "E2"], [], 100.0)
    texts = explained(spark, [many, four, context, normal, side, odd])
    assert "plus 2 additional failure signals." in texts[0]
    assert "Failure signals span positions 0 through 4 in a 5-event trace." in texts[0]
    assert "plus 1 additional failure signal." in texts[1]
    assert "plus 2 additional context-dependent signals." in texts[2]
    assert texts[3].startswith("Despite 2 normal pipeline cycles and 5 serving operations occurring")
    assert "span" not in texts[4] and "only 2 events long" not in texts[4]
    assert "deviates from the canonical HDFS replication lifecycle" in texts[5]


def test_at_most_five_sentences(one):
    text = "One. Two. Three. Four. Five. Six."
    assert one(ex.at_most_five(C("t")), t=text) == "One. Two. Three. Four. Five."
    assert one(ex.at_most_five(C("t")), t="One. Two. Three.") == "One. Two. Three."


def test_trace_checks(spark):
    rows = [
        ("a", "Fail", "3.0", "[E5]", "[]", "1"),
        ("b", "Fail", "5", "[]", "[]", ""),
        ("c", "Fail", "5", "[ , ]", "[]", ""),
        ("d", "Fail", "8", "[E5]", "[]", ""),
        ("e", " Fail ", " 5 ", "['E5', 'E2']", "[0, 2.5]", "x"),
        ("f", "Success", "5", "[E5]", "[]", ""),
    ]
    raw = spark.createDataFrame(rows, "BlockId string, Label string, Type string, Features string, TimeInterval string, Latency string")
    got = {r.block_id: r for r in tr.checked_traces(raw).collect()}
    assert {b: r.skip_reason for b, r in got.items()} == {
        "a": "unparseable type: 3.0", "b": "empty features", "c": "empty after parsing", "d": "invalid type: 8", "e": None}
    assert (got["e"].sequence, got["e"].time_interval, got["e"].latency) == (["E5", "E2"], [0.0, 2.5], None)
    sampled = {r.block_id: r.anomaly_type for r in tr.sampled_traces(raw).collect()}
    assert sampled["a"] == 3


def test_windows_of_parts_equal_windows_of_whole_blocks(spark):
    from test_parsing import events_df, hot_rows
    from logweft.operators import sessions as ss

    occurrences = events_df(spark, hot_rows(1500))
    cut = lambda rows, w, s: sorted(
        (r.block_id, r.win_ix, r.events) for r in tr.session_window_rows(rows, v.templates(), w, s).collect())
    whole = ss.sessions(occurrences, v.templates())
    parts = ss.sessions(occurrences, v.templates(), part_events=32)
    assert cut(whole, 20, 10) == cut(parts, 20, 10)
    assert cut(whole, 7, 3) == cut(parts, 7, 3)
    listed = sorted(
        (r.block_id, r.win_ix, r.events)
        for r in tr.window_rows(whole.select("block_id", F.col("sequence").alias("events")), v.templates(), 20, 10)
        .select("block_id", "win_ix", "events").collect())
    assert cut(whole, 20, 10) == listed
