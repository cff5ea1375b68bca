from pyspark.sql import functions as F

from logweft.plans import views as v
from logweft.operators import scoring as sc, sessions as ss
from logweft.sources import sinks, tables
from test_parsing import events_df


def test_session_files(spark, tmp_path):
    rows = ss.sessions(events_df(spark, [("a", 2, 0), ("a", 1, 2)]), v.templates(), with_text=True)
    sinks.write_sessions(rows, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).first().sequence == ["E3", "E1"]
    sinks.write_sessions_csv(rows, str(tmp_path / "csv"))
    row = spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').first()
    assert (row.block_id, row.sequence, row.latency) == ("a", "['E3', 'E1']", "1.0")
    assert row.text_sequence.startswith("['<*>Served block<*>to<*>', ")


def test_explanation_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", 5, ["E5", "E2"], 'says "no", twice\nhere')], "block_id string, anomaly_type int, sequence array<string>, explanation string")
    sinks.write_explanations(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"', multiLine=True).first()
    assert (back.sequence, back.explanation) == ("['E5', 'E2']", 'says "no", twice\nhere')
    sinks.write_explanations(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().explanation == 'says "no", twice\nhere'


def test_append_adds_files(spark, tmp_path):
    made = spark.createDataFrame(
        [("a", ["E5"], True, "ok", "t"), ("b", ["E5"], False, "too short (1 chars)", "t"), ("c", ["E5"], False, "failed", None)],
        "block_id string, sequence array<string>, ok boolean, reason string, t string",
    ).withColumn("messages", F.when(F.col("t").isNotNull(), F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))))
    for _ in range(2):
        sinks.append_by_verdict(made, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert tables.read_json_lines(spark, str(tmp_path / "ok")).count() == 2
    bad = spark.read.json(str(tmp_path / "no"))
    assert bad.filter("block_id = 'c' and reason = 'failed' and messages is null").count() == 2
    assert bad.filter("_reject_reason = 'too short (1 chars)' and block_id is null").count() == 2


def test_append_runs_what_made_the_rows_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def answer(prompt):
        calls.add(1)
        return prompt

    asked = spark.range(40).select(F.col("id").cast("string").alias("block_id"), F.concat(F.lit("p"), "id").alias("prompt"))
    told = sc.generate(asked, answer, output="answer").select(
        "block_id", F.array(F.lit("E5")).alias("sequence"), (F.col("answer") < "p3").alias("ok"), F.lit("why").alias("reason"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("answer").alias("content"))).alias("messages"),
    )
    sinks.append_by_verdict(told, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert calls.value == 40
    assert tables.read_json_lines(spark, str(tmp_path / "ok")).count() == 23
    assert spark.read.json(str(tmp_path / "no")).count() == 17


def test_labels_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\n")
    assert [tuple(r) for r in tables.read_labels(spark, str(tmp_path / "l.csv")).collect()] == [("blk_1", "Normal"), ("blk_2", "Anomaly")]
