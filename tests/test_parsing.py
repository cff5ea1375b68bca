import os
import random

import pytest
from pyspark.sql import functions as F

from logweft import fixed_values as fv
from logweft.operators import lines as ln, sessions as ss
from logweft.operators.templates import compile_template, load_templates, match_event, vocabulary
from logweft.plans import views as v
from logweft.sources import logs


def lines_df(spark, texts):
    return spark.createDataFrame([(t, 0, 0, i) for i, t in enumerate(texts)], "value string, file_key bigint, block_start bigint, line_id bigint")


def matched(spark, texts, templates):
    marked = ln.named_events(ln.mark_lines(lines_df(spark, texts), templates), templates)
    return [(r.reason, r.event_id) for r in marked.orderBy("line_id").collect()]


def test_first_template_in_file_order_wins(spark):
    rules = vocabulary([("A", "late<*>word"), ("B", "early")])
    assert matched(spark, ["blk_1 early late word"], rules) == [("matched", "A")]
    assert matched(spark, ["blk_1 early late word"], rules[::-1]) == [("matched", "B")]


def test_matching_ignores_case_and_crosses_wildcards(spark):
    rules = vocabulary([("A", "Received block <*> of size <*>")])
    texts = ["RECEIVED BLOCK blk_1 OF SIZE 3", "blk_1 received block x", "blk_1 é received block 1 of size 2"]
    assert matched(spark, texts, rules) == [("matched", "A"), ("unmatched", None), ("matched", "A")]


def test_case_folding_beyond_ascii(spark):
    # Kelvin sign and long s fold to k and s.
    rules = vocabulary([("A", "task")])
    assert matched(spark, ["blk_1 tasK", "blk_1 taſk", "blk_1 tašk"], rules) == [
        ("matched", "A"), ("matched", "A"), ("unmatched", None)]


def test_elastic_space(spark):
    rules = vocabulary([("A", "to delete  blk_<*>")])
    texts = ["to delete  blk_1", "to delete blk_1", "to\t delete \t blk_1"]
    assert matched(spark, texts, rules) == [("matched", "A"), ("unmatched", None), ("matched", "A")]
    rigid = vocabulary([("A", "to delete blk_<*>")], elastic=False)
    assert matched(spark, ["to delete blk_1", "to  delete blk_1"], rigid) == [("matched", "A"), ("unmatched", None)]


def test_square_wildcard_and_meta_characters(spark):
    rules = vocabulary([("A", "a+b (c) [*] $d^ \\e {f}")])
    assert matched(spark, ["blk_1 a+b (c) zz $d^ \\e {f}", "blk_1 aab c zz d e f"], rules) == [
        ("matched", "A"), ("unmatched", None)]


def test_reasons_in_order(spark):
    rules = vocabulary(fv.TEMPLATES_30)
    texts = ["", "   ", "no id here", "blk_5 unknown", "Verification succeeded for blk_5"]
    assert [r for r, _ in matched(spark, texts, rules)] == ["blank", "blank", "no_block", "unmatched", "matched"]


def test_every_message_fits_its_own_template_first(spark):
    rules = v.templates()
    texts = [m.replace("{b}", "blk_7") for m in v.MESSAGES]
    found = [e for _, e in matched(spark, texts, rules)]
    assert found[:30] == [f"E{i + 1}" for i in range(30)]
    assert found[30:] == [None, "E5"]
    plain = lines_df(spark, texts).select("line_id", match_event(F.col("value"), rules).alias("e")).orderBy("line_id")
    assert [r.e for r in plain.collect()] == found


def test_small_vocabulary_and_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("EventId,EventTemplate\n" + "".join(f"{i},{t}\n" for i, t in fv.TEMPLATES_14))
    assert load_templates(spark, str(path)) == vocabulary(fv.TEMPLATES_14)
    assert compile_template("E", "<*>x<*>").pattern == "(?isU)x"


def test_counters_add_up(spark, data):
    row = ln.parse_counters(ln.mark_lines(v.log_lines(spark, data), v.templates())).first()
    assert row.total == row.blank + row.no_block + row.unmatched + row.matched
    occurrences = v.occurrences(spark, data)
    assert occurrences.count() == row.matched
    total = v.sessions(spark, data).agg(F.sum("n_events"), F.sum(F.size("sequence")), F.count("*")).first()
    assert tuple(total) == (row.matched, row.matched, row.unique_blocks)


def events_df(spark, rows):
    """rows: (block, seconds or None, ord)"""
    df = spark.createDataFrame([(b, s, o, i) for i, (b, s, o) in enumerate(rows)], "block_id string, s int, ord short, line_id bigint")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s)")
    zero = F.lit(0).cast("bigint")
    return df.select("block_id", ts.alias("ts"), "ord", zero.alias("file_key"), zero.alias("block_start"), "line_id")


def test_order_and_latency(spark):
    rows = [("a", 2, 0), ("a", None, 1), ("a", 1, 2), ("b", 5, 3), ("c", None, 4), ("d", 7, 2), ("d", 7, 1), ("d", 7, 0)]
    got = {r.block_id: (r.sequence, r.latency) for r in ss.sessions(events_df(spark, rows), v.templates()).collect()}
    assert got == {
        "a": (["E3", "E1", "E2"], 1.0),
        "b": (["E4"], 0.0),
        "c": (["E5"], 0.0),
        "d": (["E3", "E2", "E1"], 0.0),
    }


def hot_rows(n=4000):
    rng = random.Random(3)
    return [
        ("hot" if rng.random() < 0.4 else f"b{rng.randint(1, 300)}", rng.choice([None, rng.randint(0, 200_000)]), rng.randint(0, 29))
        for _ in range(n)
    ]


def test_huge_block_in_parts_equals_one_row(spark):
    occurrences = events_df(spark, hot_rows())
    whole = {r.block_id: r for r in ss.sessions(occurrences, v.templates(), with_gaps=True).collect()}
    parts = ss.session_parts(occurrences, v.templates(), part_events=64, with_gaps=True).orderBy("block_id", "part").collect()
    glued, gaps = {}, {}
    for r in parts:
        assert len(r.sequence) <= 64 and r.first_pos == len(glued.get(r.block_id, []))
        assert (r.n_events, r.latency, r.first_seen) == (
            whole[r.block_id].n_events, whole[r.block_id].latency, whole[r.block_id].first_seen)
        glued.setdefault(r.block_id, []).extend(r.sequence)
        gaps.setdefault(r.block_id, []).extend(r.gaps)
    assert gaps == {b: r.gaps for b, r in whole.items()}
    assert glued == {b: r.sequence for b, r in whole.items()}
    assert max(r.parts for r in parts) > 20


def test_heads_are_the_first_events_of_each_block(spark):
    occurrences = events_df(spark, hot_rows())
    whole = {r.block_id: r for r in ss.sessions(occurrences, v.templates(), with_gaps=True).collect()}
    for most, part_events in ((1, 64), (100, 64), (100, 100_000), (64, 64), (5000, 7)):
        heads = ss.session_heads(occurrences, v.templates(), most, part_events, with_gaps=True).collect()
        assert {r.block_id: (r.sequence, r.gaps) for r in heads} == {
            b: (r.sequence[:most], r.gaps[:most]) for b, r in whole.items()
        }
        assert all(
            (r.n_events, r.latency, r.first_seen)
            == (whole[r.block_id].n_events, whole[r.block_id].latency, whole[r.block_id].first_seen)
            for r in heads
        )
        assert len(heads) == len(whole)
    empty = occurrences.filter("false")
    assert ss.session_heads(empty, v.templates(), 3).collect() == []


def test_facts_of_parts_equal_facts_of_whole_blocks(spark):
    from logweft.operators import blocks as bl

    occurrences = events_df(spark, hot_rows())
    facts = lambda n: sorted(
        (tuple(r) for r in bl.block_facts(ss.session_parts(occurrences, v.templates(), part_events=n, with_gaps=True)).collect()), key=repr)
    whole = facts(100_000)
    assert whole == facts(50)
    assert whole == facts(7)


def test_repartitioning_changes_nothing(spark):
    occurrences = events_df(spark, hot_rows(1500))
    key = lambda df: sorted((r.block_id, r.sequence, r.latency) for r in df.collect())
    assert key(ss.sessions(occurrences, v.templates())) == key(ss.sessions(occurrences.repartition(13), v.templates()))


def test_lines_keep_file_order(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    for name, count in (("b é+%.log", 4000), ("a.log", 10), ("c d.log", 700)):
        (tmp_path / "log" / name).write_text("".join(f"{name} {i:06d} blk_1\n" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.read_log(spark, str(tmp_path / "log"))
        assert rows.rdd.getNumPartitions() > 3
        texts = [r.value for r in rows.orderBy("file_key", "block_start", "line_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert texts == sorted(texts) and len(texts) == 4710


def test_line_ends_and_bad_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"one\r\ntwo\rthree\n\nfo\xffur")
    rows = logs.read_log(spark, str(tmp_path / "x.log")).orderBy("line_id")
    from logweft.functions import text as tx

    assert [r[0] for r in rows.select(tx.clean_line(F.col("value"))).collect()] == ["one", "two", "three", "", "fo�ur"]


def test_time_zone_and_daylight_saving_play_no_part(spark):
    texts = [f"240310 {h:02d}3000 Verification succeeded for blk_1" for h in (1, 2, 3)]
    texts += ["241103 003000 Reopen Block blk_2", "241103 023000 Reopen Block blk_2"]
    run = lambda: sorted(
        (r.block_id, r.sequence, r.latency) for r in ss.sessions(ln.events(lines_df(spark, texts), v.templates()), v.templates()).collect())
    utc = run()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[2] for r in utc] == [7200.0, 7200.0]


def test_event_matrix(spark):
    rows = ss.event_matrix(events_df(spark, [("a", 1, 0), ("a", 2, 0), ("b", 1, 29)]), v.templates()).collect()
    assert {r.block_id: (r.E1, r.E30, r.E5) for r in rows} == {"a": (2, 0, 0), "b": (0, 1, 0)}


def test_empty_result_stops(spark):
    with pytest.raises(ValueError):
        ss.require_rows(spark.range(0), "rows")
