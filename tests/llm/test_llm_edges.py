"""Every operator on nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweft.llm import bpe, mixing, multiindex, ppm, quality, simhash, substrings, tokens, toxicity, winnow
from logweft.llm.common import bucket_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "row_key _text doc score size label key prefix n start end place kind ids fingerprint spans left taken block".split()
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
ROWS = [
    (1, "alpha beta gamma delta", "en", "a", 22),
    (1, "alpha beta gamma delta", "en", "a", 22),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "no id here but words", "en", None, 20),
    (None, None, None, "b", None),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG + " one more", "en", "a", len(LONG) + 9),
    (7, "the the the " * 60, "en", "c", 720),
    (8, "naïve 日本語 \U0001f600 é", "fr", "c", 15),
]
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
def always():
    return F.col("doc_id") >= 0



def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "ppm": lambda d, l: ppm.scored(d, bucket_of("doc_id", 5) != 1, bucket_of("doc_id", 5) == 1),
    "winnow": lambda d, l: winnow.edited_and_next(d),
    "fingerprints": lambda d, l: winnow.fingerprints(d),
    "substrings": lambda d, l: substrings.deduplicated(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l, always()),
    "tokens": lambda d, l: tokens.token_files(d, WORDS, 2),
    "mix": lambda d, l: mixing.taken_words(d),
    "bpe": lambda d, l: bpe.round_trip(d, BPE, public_tokenizers.PATTERN),
    "quality": lambda d, l: quality.quality(d, l, always()),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return labels_of(spark, [(1, 1, 0), (1, 1, 0), (5, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1)])


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_its_answer(documents, labels, name):
    answers = OPERATORS[name](documents, labels).collect()
    assert sorted(str(r["doc_id"]) for r in answers) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](docs, labels_of(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels_every_score_is_a_half(spark, documents, name):
    scores = {r["score"] for r in OPERATORS[name](documents, labels_of(spark, [])).collect()}
    assert scores == {0.5}


STAGES = {
    "quality": lambda d, l: quality.keep_good(d, l),
    "near_duplicates": lambda d, l: simhash.keep_one(d),
    "substrings": lambda d, l: substrings.without_repeats(d),
    "mixing": lambda d, l: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(spark, documents, labels, name):
    out = STAGES[name](documents, labels)
    assert out.columns == documents.columns
    assert all(r["row_key"] == "clash" for r in out.collect())
    empty = STAGES[name](documents.filter("false"), labels_of(spark, []))
    assert empty.columns == documents.columns and empty.count() == 0


def test_near_duplicates_leave_one_of_each_group(documents):
    kept = [r["doc_id"] for r in simhash.keep_one(documents).collect()]
    assert kept.count(1) == 1 and 5 in kept and 6 not in kept


def test_vectors_that_cannot_link(spark):
    good, nan, inf = [1.0, 2.0, 0.0, 1.0], float("nan"), float("inf")
    rows = [
        (1, good, 1), (2, good, 1), (3, [2.0, 4.0, 0.0, 2.0], 1), (4, good, 2), (5, good, None), (6, None, 1),
        (7, [0.0] * 4, 1), (8, [1.0, None, 0.0, 1.0], 1), (9, [1.0, nan, 0.0, 1.0], 1), (10, [1.0, inf, 0.0, 1.0], 1),
        (None, [-1.0, 0.0, 0.0, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n", F.lit(0))
    got = {r["vec_id"]: tuple(r)[1:] for r in multiindex.linked_vectors(table).collect()}
    assert got[1] == (2, 1, True) and got[2] == got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in range(4, 11)) and got[None] == (0, None, True)
    assert multiindex.linked_vectors(table.filter("false")).collect() == []


def test_the_pipeline_has_its_stages(spark, data):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "substrings", "mixing", "encoding",
    ]
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 50 and got.filter("NOT round_trip").isEmpty()
