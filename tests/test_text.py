import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from logweft.functions import text as tx
from logweft.plans.training import MASK_SQL

C = F.col


def column_of(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.r for r in rows.select("i", expression.alias("r")).orderBy("i").collect()]


def test_strip_takes_the_same_characters_as_python(spark):
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = [f"{w}a{w}b{w}" for w in odd] + ["  x\t", "", " 　 "]
    assert column_of(spark, values, tx.strip(C("t"))) == [v.strip() for v in values]


def test_invalid_bytes_are_replaced(spark):
    row = spark.createDataFrame([(bytearray(b"ab\xffcd \n"),)], "b binary")
    assert row.select(tx.clean_line(C("b").cast("string"))).first()[0] == "ab�cd"


def test_block_id(spark):
    values = ["x blk_-12 blk_7", "blk_7x", "blk_", "BLK_7", ""]
    assert column_of(spark, values, tx.block_id(C("t"))) == ["blk_-12", "blk_7", None, None, None]


def test_loose_block_id_is_repeatable(spark):
    first, second, third = column_of(spark, ["a blk_1-2", "none", "none"], tx.loose_block_id(C("t")))
    assert first == "blk_1-2"
    assert second == third and re.fullmatch(r"blk_-?\d+", second)


@pytest.mark.parametrize(
    "line, expected",
    [
        ("081109 203518 143 INFO", datetime.datetime(2008, 11, 9, 20, 35, 18)),
        ("690101 000000", datetime.datetime(1969, 1, 1)),
        ("681231 235959", datetime.datetime(2068, 12, 31, 23, 59, 59)),
        ("081399 256199 x", None),
        ("080230 000000", None),
        ("080229 000060", None),
        ("080229 000061", None),
        ("080229\t\t010203", datetime.datetime(2008, 2, 29, 1, 2, 3)),
        (" 080229 010203", None),
        ("08022 9010203", None),
        ("", None),
    ],
)
def test_log_time(one, line, expected):
    assert one(tx.log_time(C("t")), t=line) == expected


def test_lists(one):
    assert one(tx.comma_list(C("t")), t=" a, ,b ,") == ["a", "b"]
    assert one(tx.comma_list(C("t"), keep_empty=True), t=" a, ,b ,") == ["a", "", "b", ""]
    assert one(tx.bracket_list(C("t")), t="[E5, E22]") == ["E5", "E22"]
    assert one(tx.bracket_list(C("t")), t="""['E5', "E22"]""") == ["E5", "E22"]
    assert one(tx.bracket_list(C("t")), t="[]") == []
    assert one(tx.raw_bracket_list(C("t")), t="[]") == [""]
    assert one(tx.sampled_list(C("t")), t="['E5', '', 'E2']") == ["E5", "E2"]
    assert one(tx.number_list(C("t")), t="[0.0, 1.5]") == [0.0, 1.5]
    assert one(tx.number_list(C("t")), t="[0.0, oops") == []
    assert one(tx.number_list(C("t")), t=None) == []
    assert one(tx.number(C("t")), t=" 3.5 ") == 3.5
    assert one(tx.number(C("t")), t="x") is None
    assert one(tx.python_list(C("t")), t=["E5", "E2"]) == "['E5', 'E2']"
    assert one(tx.python_list(C("t")), t=[]) == "[]"


@pytest.mark.parametrize(
    "seconds, text",
    [
        (None, "unknown"),
        (0.0, "0 seconds"),
        (59.4, "59 seconds"),
        (60.0, "1.0 minutes"),
        (90.0, "1.5 minutes"),
        (3599.0, "60.0 minutes"),
        (3600.0, "1.0 hours"),
        (3802.0, "1.1 hours"),
        (86400.0, "24.0 hours"),
    ],
)
def test_latency_text(one, seconds, text):
    assert one(tx.latency_text(C("s").cast("double")), s=seconds) == text


@pytest.mark.parametrize(
    "text, masked",
    [
        ("Trueblue", "<*>blue"),
        ("éa1", "é<*>"),
        ("one fine Monday", "<*> fine <*>"),
        ("Jan 5 x", "<*>x"),
        ("from /10.0.0.1:50010 now", "from <*> now"),
        ("10.0.0.1:80", "<*>"),
        ("a.b@c-d.e", "<*>"),
        ("deadbeef", "<*>"),
        ("wait.....now", "wait.. now"),
        ("plain words", "plain words"),
        ("block ;-; block", "block ;-; block"),
        ("[/a/b]", "[<*>]"),
    ],
)
def test_mask(one, text, masked):
    assert one(tx.mask_parameters(C("t")), t=text) == masked


def test_mask_equals_the_plain_alternatives(spark):
    plain = re.compile(MASK_SQL)
    rng = random.Random(11)
    parts = (
        "True|one|Mon|Jan 5 x|10.0.0.1:80|ab:cd:ef:ab:cd:ef|/a/b|\\x|deadbeef|cafebabe12|a@b|a.b@c-d.e|x|é|_|-|.|:|/| |"
        "[|]|1|a|F|..|....|@|\t|May 12 |ünï|٣|a_b"
    ).split("|")
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    expected = [plain.sub("<*>", re.sub(r"[.]{3,}", ".. ", v)) for v in values]
    assert column_of(spark, values, tx.mask_parameters(C("t"))) == expected


def test_mask_survives_long_runs(one):
    assert one(tx.mask_parameters(C("t")), t="/x" * 30_000) == "<*>"
    for run in ("a" * 60_000, "a.b" * 20_000, "a-b_" * 15_000):
        assert one(F.length(tx.mask_parameters(C("t"))), t=run) == len(run)


def test_sentences(one):
    assert one(F.size(tx.sentences(C("t"))), t="One. Two v1.2 here.  Three.") == 3
    assert one(F.size(tx.sentences(C("t"))), t="") == 0
    assert one(tx.squeeze_spaces(C("t")), t="a  b   c") == "a b c"


def test_keyword_events(one):
    assert one(tx.keyword_events(C("t")), t="PacketResponder 1 terminating") == ["E11", "E5"]
    assert one(tx.keyword_events(C("t")), t="nothing") == ["E1"]
