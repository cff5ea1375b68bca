"""Growing files, keyed sessions and bounded state over many batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logweft.operators import lines as ln
from logweft.plans import views as v, watch
from logweft.sources import tail
from logweft.streaming import keyed, live


def line(second, block, text="Verification succeeded for"):
    return f"240101 {second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d} 7 INFO x: {text} blk_{block}"


def lines_read(spark, path):
    return sorted(r.value for r in spark.read.parquet(path).collect())


# -- the tail of growing files ---------------------------------------------


def test_appended_lines_arrive_once(spark, tmp_path):
    log, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    log.mkdir()
    a, b = log / "a.log", log / "b.log"

    def run():
        live.drain(tail.tail_log(spark, f"file://{log}"), live.append_once(out), state)
        return lines_read(spark, out)

    a.write_text("a1\na2\na3 is half")
    assert run() == ["a1", "a2"]
    with a.open("a") as f:
        f.write(" written\na4\r\n")
    b.write_text("b1\n\nb2\n")
    want = ["", "a1", "a2", "a3 is half written", "a4", "b1", "b2"]
    assert run() == want
    assert run() == want  # nothing new
    with a.open("a") as f:
        f.write("a5\n")
    a.rename(log / "a.log.1")  # rotated with a line that was not read yet
    a.write_text("new1\n")
    want = sorted([*want, "a5", "new1"])
    assert run() == want
    with a.open("a") as f:
        f.write("new2\n")
    b.write_text("other b\n")  # cut short and written anew
    want = sorted([*want, "new2", "other b"])
    assert run() == want
    places = {(r.file_key, r.line_id): r.value for r in spark.read.parquet(out).filter("batch < 2").collect()}
    assert places[str(a), 0] == "a1" and places[str(a), 3] == "a2" and places[str(b), 4] == "b2"


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_splits_hold_each_line_once(spark, tmp_path, split):
    rnd = random.Random(split)
    rows = ["x" * rnd.choice([0, 1, 5, 40]) + f"é{i}" for i in range(60)]
    (tmp_path / "f.log").write_text("\n".join(rows) + "\n")
    reader = tail.TailReader([str(tmp_path)], 10, split)
    start = reader.initialOffset()
    end = reader.latestOffset()
    got = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"] for r in got] == rows
    data = (tmp_path / "f.log").read_bytes()
    assert all(data[r["line_id"] :].startswith(r["value"].encode()) for r in got)
    assert reader.partitions(end, reader.latestOffset()) == []


def test_a_file_that_is_gone_is_named(tmp_path):
    (tmp_path / "f.log").write_text("one\n")
    reader = tail.TailReader([str(tmp_path)], 10, 100)
    (part,) = reader.partitions({}, reader.latestOffset())
    (tmp_path / "f.log").unlink()
    with pytest.raises(FileNotFoundError, match="f.log"):
        list(reader.read(part))


# -- keyed sessions ----------------------------------------------------------


def write_batches(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:02}.log").write_text("\n".join(rows) + "\n")


def run_sessions(spark, tmp_path, batches, gap, delay, flush=True):
    write_batches(tmp_path / "in", batches)
    lines = tail.tail_log(spark, str(tmp_path / "in"), files_per_batch=1)
    marks = keyed.mark_stream(spark, str(tmp_path / "marks"))
    closed = keyed.gap_sessions(live.parse_stream(lines, v.templates()), gap, delay, marks)
    out = str(tmp_path / "out")
    with live.caught_up(closed, live.append_once(out), str(tmp_path / "state")) as query:
        before = spark.read.parquet(out).count()
        if flush:
            keyed.request_flush(spark, str(tmp_path / "marks"))
            query.processAllAvailable()
        late = live.rows_dropped_late(query)
        batches_run = query.lastProgress["batchId"] + 1
    rows = spark.read.parquet(out).collect()
    return sorted((r.block_id, r.n_events, r.latency, tuple(r.ords)) for r in rows), late, before, batches_run


def plain_sessions(events, gap):
    """(block, second, place, ord) to sessions, in memory."""
    out, of = [], {}
    for block, second, place, ord in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if block in of and second - of[block][-1][0] < gap:
            of[block].append((second, ord))
        else:
            of[block] = [(second, ord)]
            out.append((block, of[block]))
    return sorted((b, len(s), float(s[-1][0] - s[0][0]), tuple(o for _, o in s)) for b, s in out)


TEXTS = {"Verification succeeded for": 1, "Reopen Block": 18, "Received block": None}


def test_five_batches_with_late_rows_equal_batch_without_them(spark, tmp_path):
    rnd = random.Random(5)
    ords = {t: i for t, i in ((t, ln_ord(spark, t)) for t in ("Verification succeeded for", "Reopen Block")) }
    batches, events, late, high = [], [], 0, None
    for k in range(6):
        rows = []
        for n in range(40):
            second = k * 1000 + rnd.randrange(1000)
            if k == 5 and n < 12:
                second = rnd.randrange(2000)  # far behind
            text, block = rnd.choice(list(ords)), rnd.randrange(4)
            if k and second <= high - 60:
                late += 1
            else:
                events.append((f"blk_{block}", second, (k, n), ords[text]))
            rows.append(line(second, block, text))
        batches.append(rows)
        seconds = [int(r[7:9]) * 3600 + int(r[9:11]) * 60 + int(r[11:13]) for r in rows]
        high = max([high or 0, *seconds])
    got, dropped, before, batches_run = run_sessions(spark, tmp_path, batches, 120, "60 seconds")
    assert late >= 12 and dropped == late and batches_run >= 6
    want = plain_sessions(events, 120)
    assert got == want and 0 < before < len(want)


def ln_ord(spark, text):
    row = spark.createDataFrame([(line(1, 1, text),)], "value string").select(
        "value", F.lit("f").alias("file_key"), F.lit(0).alias("block_start"), F.lit(0).alias("line_id")
    )
    return ln.events(row, v.templates()).first().ord


def test_open_sessions_wait_without_a_flush(spark, tmp_path):
    batches = [[line(0, 1), line(30, 1), line(40, 2)], [line(400, 1), line(420, 1)], [line(2000, 9)], [line(2001, 9)], [line(2002, 9)]]
    got, dropped, before, _ = run_sessions(spark, tmp_path, batches, 60, "10 seconds", flush=False)
    assert [(b, n, t) for b, n, t, _ in got] == [("blk_1", 2, 20.0), ("blk_1", 2, 30.0), ("blk_2", 1, 0.0)]
    assert dropped == 0


def test_state_is_keyed_by_buckets_not_by_blocks(spark, tmp_path):
    """Calls of the keyed step are bounded, however many blocks a batch has."""
    blocks = 3 * keyed.BUCKETS
    rows = [line(second, block) for second in (0, 30, 400) for block in range(blocks)]
    write_batches(tmp_path / "in", [rows])
    marks = keyed.mark_stream(spark, str(tmp_path / "marks"))
    closed = keyed.gap_sessions(live.parse_stream(tail.tail_log(spark, str(tmp_path / "in")), v.templates()), 60, "10 seconds", marks)
    out = str(tmp_path / "out")
    with live.caught_up(closed, live.append_once(out), str(tmp_path / "state")) as query:
        keyed.request_flush(spark, str(tmp_path / "marks"))
        query.processAllAvailable()
        held = [operator["numRowsTotal"] for p in query.recentProgress for operator in p["stateOperators"]]
    assert 0 < max(held) <= keyed.BUCKETS and held[-1] == 0
    got = sorted((r.block_id, r.n_events, r.latency) for r in spark.read.parquet(out).collect())
    assert got == sorted((f"blk_{b}", n, t) for b in range(blocks) for n, t in ((2, 30.0), (1, 0.0)))


def test_cut_sessions_parts_at_the_gap():
    events = [(5, "b"), (0, "a"), (9, "c"), (14, "d"), (14, "c")]
    assert keyed.cut_sessions(events, 5) == [[(0, "a")], [(5, "b"), (9, "c")], [(14, "c"), (14, "d")]]


def test_settings_are_restored(spark):
    key = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(key, None)
    with live.query_settings(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before


# -- bounded state over many batches -----------------------------------------


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "block_id string, ts timestamp, status string")


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_one_row_per_block_without_reading_history(spark, tmp_path):
    """Fifty batches: each reads its own rows, whatever was stored before, and a block
    comes out once; a batch that is written again changes nothing."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(50):
        rows_of(spark, [(f"b{k}", at(k), "x"), (f"b{k // 2}", at(k), "x"), ("b0", at(k), "x")]).coalesce(1).write.mode("append").parquet(source)
    schema = "block_id string, ts timestamp, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    once = live.once_per_key(stream, delay="1 day")
    query = live.drain(once, live.append_once(out), str(tmp_path / "state"))
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == 50 and set(read) == {3}
    assert sorted(r.block_id for r in spark.read.parquet(out).collect()) == sorted(f"b{k}" for k in range(50))
    again = spark.read.parquet(out).filter("batch = 7").drop("batch")
    again = spark.createDataFrame(again.collect(), again.schema)
    live.append_once(out)(again, 7)
    assert spark.read.parquet(out).count() == 50
    rows_of(spark, [("b3", at(60), "x"), ("new", at(60), "x")]).coalesce(1).write.mode("append").parquet(source)
    live.drain(once, live.append_once(out), str(tmp_path / "state"))
    assert spark.read.parquet(out).filter("block_id = 'new'").count() == 1 and spark.read.parquet(out).count() == 51


def test_at_most_three_snapshots_exist(spark, tmp_path):
    path = str(tmp_path / "state")
    for k in range(200):
        live.write_snapshot(spark.range(k, k + 1).coalesce(1), path, k)
        assert len(os.listdir(path)) <= 3
    assert [r.id for r in live.snapshot(spark, path).collect()] == [199]
    assert [r.id for r in live.snapshot_before(spark, path, 199).collect()] == [198]


def test_replayed_and_unfinished_batches_leave_the_buffer_right(spark, tmp_path):
    path = str(tmp_path / "recent")
    write = live.keep_recent(path, "n", 5)
    batch = lambda k: spark.range(k * 3, k * 3 + 3).select(F.col("id").alias("n"))
    for k in range(6):
        write(batch(k), k)
    want = [13, 14, 15, 16, 17]
    assert sorted(r.n for r in live.snapshot(spark, path).collect()) == want
    write(batch(5), 5)  # replayed after a restart
    assert sorted(r.n for r in live.snapshot(spark, path).collect()) == want
    (tmp_path / "recent" / "6").mkdir()  # a batch that died before its snapshot was complete
    assert sorted(r.n for r in live.snapshot(spark, path).collect()) == want


def test_late_rows_correct_their_windows(spark, tmp_path):
    batches = [
        [("a", at(0), "Anomalous"), ("b", at(119), "Anomalous")],
        [("a", at(500), "Anomalous"), ("c", at(500), "Normal")],
        [("a", at(10), "Anomalous"), ("d", at(130), "Anomalous"), ("e", at(501), "Anomalous"), ("f", at(5), "Normal")],
    ]
    counts = live.add_counts(str(tmp_path / "counts"), live.anomaly_windows)
    late = live.keep_late(str(tmp_path / "late"))
    for k, rows in enumerate(batches):
        for _ in range(2):  # each batch runs twice
            counts(rows_of(spark, rows), k)
            late(rows_of(spark, rows), k)
    got = {r.window_start: r.n for r in live.snapshot(spark, str(tmp_path / "counts")).collect()}
    assert got == {at(0): 3, at(120): 1, at(480): 2}
    side = spark.read.parquet(str(tmp_path / "late" / "late")).collect()
    assert sorted((r.block_id, r.ts) for r in side) == [("a", at(10)), ("d", at(130)), ("f", at(5))]


# -- the live job ------------------------------------------------------------


def test_watched_log_goes_on_after_a_restart(spark, tmp_path):
    log, out = tmp_path / "in", str(tmp_path / "out")
    log.mkdir()
    (log / "a.log").write_text("\n".join([line(0, 1), line(30, 1, "Exception in receiveBlock for block"), line(40, 2)]) + "\n")
    run = lambda: watch.watch_log(spark, str(log), v.templates(), out, 60, "10 seconds", every="0 seconds")
    query = run()
    query.processAllAvailable()
    query.stop()
    with (log / "a.log").open("a") as f:
        f.write("\n".join([line(400, 1), line(420, 1)]) + "\n")
    watch.finish(run(), spark, out)
    history = spark.read.parquet(f"{out}/history").collect()
    got = sorted((r.block_id, r.n_events, r.latency, r.status) for r in history)
    assert got == [("blk_1", 2, 20.0, "Normal"), ("blk_1", 2, 30.0, "Anomalous"), ("blk_2", 1, 0.0, "Normal")]
    (alert,) = spark.read.parquet(f"{out}/alerts").collect()
    assert alert.block_id == "blk_1" and len(alert.explanation) > 20
    assert tuple(watch.totals(spark, out).first()) == (3, 1, 2, pytest.approx(50 / 3))
