"""Gates on generated texts and the report on a set of explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweft import fixed_values as fv
from logweft.functions import sequences as sq, text as tx
from logweft.operators.explain import sentence_count


def gate_reason(text: Column, min_chars: int = fv.MIN_TEXT_CHARS) -> Column:
    """``ok``, or why a text is turned down."""
    n = F.char_length(text)
    low = F.lower(text)
    chain = F.when(n < min_chars, tx.fill("too short ({n} chars)", n=n))
    for opener in fv.BAD_OPENERS:
        chain = chain.when(F.startswith(low, F.lit(opener)), f"bad opener: '{opener}'")
    real = F.filter(F.split(text, r"\.", -1), lambda s: F.char_length(tx.strip(s)) > fv.MIN_SENTENCE_CHARS)
    return chain.when(F.size(real) < fv.MIN_SENTENCES, "fewer than 2 real sentences").otherwise("ok")


def gate(rows: DataFrame, text: str, min_chars: int = fv.MIN_TEXT_CHARS) -> DataFrame:
    """Add ``reason`` and ``ok``; a missing text failed upstream.

    The reason is worked out once per row: ``ok`` reads the exploded column.
    """
    reason = F.when(F.col(text).isNull(), fv.CALL_FAILED).otherwise(gate_reason(F.col(text), min_chars))
    return rows.select("*", F.explode(F.array(reason)).alias("reason")).withColumn("ok", F.col("reason") == "ok")


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("ok", "reason").agg(F.count(F.lit(1)).alias("n"))


def low_yield(gated: DataFrame, at_least: int = fv.LOW_YIELD) -> DataFrame:
    accepted = F.count_if("ok")
    return gated.agg(
        accepted.alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"), (accepted < at_least).alias("low_yield")
    )


def breakdown(rows: DataFrame, column: str = "anomaly_type") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def report(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals over ``sequence`` and ``explanation``."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    facts = rows.select(
        sq.fingerprint(F.col("sequence")).alias("fp"),
        F.md5("explanation").alias("text_hash"),
        sentence_count(F.col("explanation")).alias("n"),
        F.startswith("explanation", F.lit("Type ")).alias("typed"),
        (F.contains("explanation", F.lit("- ")) | F.contains("explanation", F.lit("* "))).alias("bullets"),
    )
    totals = facts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct("fp").alias("distinct_sequences"),
        distinct("text_hash").alias("distinct_texts"),
        F.min("n").alias("min_sentences"),
        F.max("n").alias("max_sentences"),
        F.avg("n").alias("avg_sentences"),
        F.count_if(~F.col("n").between(3, 5)).alias("out_of_range"),
        F.count_if("typed").alias("typed_openers"),
        F.count_if("bullets").alias("with_bullets"),
    )
    return totals.withColumn("distinct_ratio", F.col("distinct_texts") / F.greatest("n_rows", F.lit(1)))


def sentence_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(sentence_count(F.col("explanation")).alias("sentences")).agg(F.count(F.lit(1)).alias("n"))


def leaked_codes(rows: DataFrame, column: str = "explanation") -> DataFrame:
    """Distinct event codes that slipped into texts; no rows is a pass."""
    codes = F.regexp_extract_all(column, F.lit(r"(?U)\bE\d+\b"), F.lit(0))
    return rows.select(F.explode(codes).alias("code")).distinct()


def first_per_type(rows: DataFrame, order: Column, chars: int = 250) -> DataFrame:
    preview = F.substring("explanation", 1, chars)
    return rows.groupBy("anomaly_type").agg(F.min_by(preview, order).alias("sample"))


def rotation_sample(rows: DataFrame, order: str, chars: int = 180) -> DataFrame:
    """Three explanations of the (type, sequence) that is first to occur three times.

    ``rotation`` steps 0, 1, 2 first appear with the first three occurrences, so
    the earliest row of step 2 marks the winner and per-step minima its rows.
    """
    keyed = rows.withColumn("fingerprint", sq.fingerprint(F.col("sequence")))
    keys = ["anomaly_type", "fingerprint"]
    winner = keyed.filter("rotation = 2").orderBy(order).limit(1).select(*keys)
    shown = keyed.join(F.broadcast(winner), keys, "left_semi").filter("rotation < 3")
    preview = F.substring("explanation", 1, chars)
    return shown.groupBy("anomaly_type", "rotation").agg(F.min_by(preview, F.col(order)).alias("preview"))
