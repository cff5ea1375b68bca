"""Keep-first by digest, copies over many tasks, the split job."""

import random

import pytest
from pyspark.sql import functions as F

from logweft.operators import ranking, samples as sm
from logweft.plans import catalog, jobs


def plain(rows):
    first = {}
    for key, order, value in sorted(rows, key=lambda r: r[1]):
        first.setdefault(key, (key, order, value))
    return sorted(first.values(), key=repr)


@pytest.mark.parametrize("whole", [True, False])
def test_first_of_each_key(spark, whole):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "", "a", "b" * 50, f"k{i % 40}"]), n, f"v{i}") for i, n in enumerate(rnd.sample(range(10_000), 400))]
    df = spark.createDataFrame(rows, "key string, n bigint, value string").repartition(3)
    order = F.col("n") if whole else F.struct(F.lpad(F.col("n").cast("string"), 6, "0").alias("file"), "n")
    got = [tuple(r) for r in ranking.keep_first(df, ["key"], order).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_equal_digests_are_told_apart_by_the_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking.F, "xxhash64", lambda *columns: F.length(F.coalesce(columns[-1] if not isinstance(columns[-1], str) else F.col(columns[-1]), F.lit(""))).cast("bigint"))
    rows = [(k, n, f"v{n}") for n, k in enumerate(["aa", "bb", "aa", "cc", "bb", "d", None, "", None])]
    df = spark.createDataFrame(rows, "key string, n bigint, value string")
    got = [tuple(r) for r in ranking.keep_first(df, ["key"], F.col("n")).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_empty_and_two_keys(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 1, 3)], "x string, y int, n bigint")
    assert sorted(tuple(r) for r in ranking.keep_first(df, ["x", "y"], F.col("n")).collect()) == [("a", 1, 3), ("a", 2, 4)]
    assert ranking.keep_first(df.filter("false"), ["x"], F.col("n")).collect() == []


@pytest.mark.parametrize("name", ["masked_dedup", "corpus_union_dedup", "sequence_fingerprint_dedup"])
def test_no_whole_rows_are_sorted(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_copies_of_one_row_use_all_tasks(spark):
    rows = spark.createDataFrame([(1, "x")], "id bigint, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copied = sm.repeated(rows, F.lit(1_000_000), 1_000_000, "copy")
        per_task = [r["count"] for r in copied.groupBy(F.spark_partition_id()).count().collect()]
        low, high, n = copied.agg(F.min("copy"), F.max("copy"), F.count_distinct("copy")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (low, high, n) == (1, 1_000_000, 1_000_000) and len(per_task) == 4 and max(per_task) < 1.3 * min(per_task)
    few = spark.createDataFrame([(1, 0), (2, 3)], "id bigint, times int").filter("times > 0")
    assert [r.copy for r in sm.repeated(few, F.col("times"), 300, "copy").orderBy("copy").collect()] == [1, 2, 3]
    assert [r.copy for r in sm.repeated(few, F.col("times"), 3, "copy").orderBy("copy").collect()] == [1, 2, 3]
