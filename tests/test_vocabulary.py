"""Large vocabularies against the chain of all patterns, and ranges of hot blocks."""

import random

import pytest
from pyspark.sql import functions as F

from logweft.operators import sessions as ss, templates as tp, vocabulary as vc
from logweft.operators.ranking import range_numbered, ranged

WORDS = "block served Received size of 67 src dest é ſafe Kelvin up - : BLOCK* a/b x.y".split()


def table_of(spark, rows):
    return vc.compiled(spark.createDataFrame([(i, f"T{i}", t) for i, t in enumerate(rows)], "ord bigint, EventId string, EventTemplate string"))


def lines_of(spark, values):
    rows = [(value, "f", 0, i) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, "value string, file_key string, block_start bigint, line_id bigint").repartition(3)


def test_equal_to_the_chain_on_500_templates(spark):
    rnd = random.Random(3)
    piece = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(n))
    rows = []
    for i in range(500):
        parts = [piece(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 3))]
        rows.append(rnd.choice(["<*>", "<*> ", " <*> ", "<*>."]).join(parts) + rnd.choice(["", "<*>", " <*>", "[*]"]))
    rows += ["<*>", "up", "<*> - <*>", "xyz", "KELVIN <*> ſAFE", "rved bl", "İ é <*> up"]
    values = []
    for _ in range(1500):
        text = rnd.choice(rows).replace("[*]", "<*>")
        while "<*>" in text:
            text = text.replace("<*>", rnd.choice(["", "x", " 17 blk ", "served", "ü"]), 1)
        text = "".join(rnd.choice([c, c.upper(), c.lower()]) if rnd.random() < 0.2 else c for c in text)
        values.append(rnd.choice(["", "pre", "pre "]) + text.replace(" ", rnd.choice([" ", "  ", "\t"])) + rnd.choice(["", "s", " end"]))
    values += ["", "nothing to find here?", "Kelvin K ſ", "STRASSE \U0001f600"]
    lines = lines_of(spark, values)
    for vocabulary in (rows, [r for r in rows if r not in ("<*>", "up", "<*> - <*>")]):
        chain = tp.vocabulary([(f"T{i}", t) for i, t in enumerate(vocabulary)])
        want = {r.line_id: r.ord for r in tp.with_match(lines, chain, F.lit(True)).collect() if r.ord is not None}
        got = vc.matches(lines, vc.template_index(table_of(spark, vocabulary)), ["value"]).collect()
        assert {r.line_id: r.ord for r in got} == want and len(got) == len(want)
        assert all(r.event_id == f"T{r.ord}" and r.value == values[r.line_id] for r in got)
        assert len(want) > 500


@pytest.mark.parametrize(
    "text, words, grams",
    [
        ("<*> Served block <*>", ["block", "served"], ["bloc", "erve", "lock", "rved", "serv"]),
        ("Served", [], ["erve", "rved", "serv"]),
        ("<*>a b<*>", [], []),
        ("(x) é12 y", ["x"], []),
        ("", [], []),
    ],
)
def test_literal_keys(text, words, grams):
    assert vc.literal_keys(text) == (words, grams)


def test_vocabulary_of_several_files_without_a_limit(spark, tmp_path):
    names = []
    for k, count in enumerate([12_000, 8_000]):
        path = str(tmp_path / f"{k}.csv")
        with open(path, "w") as f:
            f.write("EventId,EventTemplate\n" + "".join(f'E{k}_{i},"found item{i} of ""set{k}"" <*>"\n' for i in range(count)))
        names.append(path)
    table = vc.load_vocabulary(spark, names)
    assert table.count() == 20_000
    first = table.orderBy("ord").select("ord", "event_id").collect()
    assert [r.ord for r in first] == list(range(20_000)) and first[0].event_id == "E0_0" and first[-1].event_id == "E1_7999"
    lines = lines_of(spark, ['we Found item7999 of "set1" now', 'found item12 of "set0" ', 'found item12 of "set0"x', "found item1"])
    index = vc.template_index(table)
    assert index.count() == 20_000 and index.groupBy("key").count().agg(F.max("count")).first()[0] <= 2
    got = {r.line_id: r.event_id for r in vc.matches(lines, index).collect()}
    assert got == {0: "E1_7999", 1: "E0_12"}


def test_one_block_with_most_events_in_one_second_of_many_files(spark):
    """90 % of 40 000 events in one second of one block, out of 1 000 files: no range has
    over twice the rows of the median one, and positions are exact."""
    hot = F.col("id") % 10 != 0
    rows = spark.range(40_000).select(
        F.when(hot, F.lit("blk_hot")).otherwise(F.concat(F.lit("blk_"), (F.col("id") % 997).cast("string"))).alias("block_id"),
        F.when(hot, F.lit(5)).otherwise(F.col("id") % 86_400).alias("_at"),
        F.concat(F.lit("f"), F.pmod(F.hash("id"), F.lit(1000)).cast("string")).alias("file_key"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("id").alias("line_id"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these ranges are tiny
    sizes = sorted(r["count"] for r in ranged(rows, ss.EVENT_ORDER, ["block_id"]).groupBy("_range").count().collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = range_numbered(rows, "pos", ss.EVENT_ORDER, ["block_id"]).collect()
    by_block = {}
    for r in got:
        by_block.setdefault(r.block_id, []).append(((r._at, r.file_key, r.line_id), r.pos))
    assert len(got) == 40_000
    for own in by_block.values():
        assert [p for _, p in sorted(own)] == list(range(len(own)))


def test_positions_without_groups(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"))
    assert all(r.n == r.pos for r in range_numbered(rows, "pos", ["n"]).collect())
    assert range_numbered(rows.filter("false"), "pos", ["n"]).collect() == []
