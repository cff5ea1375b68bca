"""One query per operator, in its contract's columns."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft.llm import bpe, mixing, multiindex, packing, ppm, quality, runs, simhash, substrings, tokens, toxicity, variants, winnow
from logweft.llm.common import bucket_of, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = bucket_of("doc_id", 5)
    return ppm.scored(table(spark, sf_dir, "documents"), learn_from=remainder != 1, held_out=remainder == 1)


@query
def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_and_next(table(spark, sf_dir, "documents"))


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _judged(toxicity.toxicity(docs, labels, bucket_of("doc_id", 5) != 0), bucket_of("doc_id", 5) == 0)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


ORACLES["op7_mix"] = mixing.taken_sql()


@query
def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.linked_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _judged(quality.quality(docs, labels, bucket_of("doc_id", 3) != 1), bucket_of("doc_id", 3) == 1)


def _periodic_end(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The stated edit: in one of ten documents, words from some place on go round."""
    checksum, size = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or checksum % 10 or not size:
        return words
    seed = checksum // 10
    start = seed % size
    cycle = words[start : start + 1 + (size - start) // (3 + seed % 8)]
    return words[:start] + (cycle * ((size - start) // len(cycle) + 1))[: size - start]


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(table(spark, sf_dir, "documents"), edit=_periodic_end))


@query
def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.digests(packing.pieces(table(spark, sf_dir, "documents"), path, end_id=0))


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), edit=variants.one_letter_less)


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
