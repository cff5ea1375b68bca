import os

from pyspark.sql import functions as F

from logweft.operators import sessions as ss
from logweft.plans import views as v
from logweft.sources import logs
from logweft.streaming import live


def write_files(folder, batches):
    """One text file per batch, read in order of modification time."""
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(batches):
        path = folder / f"{i}.log"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))


def line(second, block, text="Verification succeeded for"):
    return f"240101 {second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d} 7 INFO x: {text} blk_{block}"


def test_stored_stream_equals_batch_sessions(spark, tmp_path):
    batches = [[line(5, 1), line(5, 1, "Reopen Block"), line(5, 2)], [line(5, 1, "writeBlock received exception"), line(1, 2, "Reopen Block")]]
    write_files(tmp_path / "in", batches)
    live.drain(
        logs.stream_log(spark, str(tmp_path / "in"), max_files=1),
        live.store_occurrences(str(tmp_path / "occ"), v.templates()),
        str(tmp_path / "state"),
    )
    key = lambda df: sorted((r.block_id, r.sequence, r.latency) for r in ss.sessions(df, v.templates()).collect())
    streamed = key(spark.read.parquet(str(tmp_path / "occ")))
    from logweft.operators import lines as ln

    assert streamed == key(ln.events(logs.read_log(spark, str(tmp_path / "in")), v.templates()))
    assert streamed == [("blk_1", ["E2", "E19", "E7"], 0.0), ("blk_2", ["E19", "E2"], 4.0)]


def test_recent_buffer_over_batches(spark, tmp_path):
    write_files(tmp_path / "in", [[f"{i:03d}" for i in range(k, k + 50)] for k in (0, 50, 100)])
    lines = logs.stream_log(spark, str(tmp_path / "in"), max_files=1).select("value")
    live.drain(lines, live.keep_recent(str(tmp_path / "out"), "value"), str(tmp_path / "state"))
    got = sorted(r.value for r in live.snapshot(spark, str(tmp_path / "out")).collect())
    assert got == [f"{i:03d}" for i in range(70, 150)]


def test_replayed_batch_is_stored_once(spark, tmp_path):
    write = live.append_once(str(tmp_path / "out"))
    rows = spark.range(5).select(F.col("id").cast("string").alias("block_id"))
    for _ in range(2):
        write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    write_files(tmp_path / "in", [["a", "b"]])
    run = lambda: live.drain(
        live.live_lines(logs.stream_log(spark, str(tmp_path / "in"))), live.append_once(str(tmp_path / "out")), str(tmp_path / "state"))
    run()
    (tmp_path / "in" / "late.log").write_text("c\n\n  \n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in rows.collect()) == ["a", "b", "c"]
    assert rows.select(live.clock_time(F.col("ts")).alias("t")).first().t.count(":") == 2
