"""The model boundary: scoring hooks, reply parsing, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweft import fixed_values as fv, schemas
from logweft.functions import sequences as sq, text as tx
from logweft.functions.render import after_marker
from logweft.operators.calls import Caller

Scorer = Callable[[list[str]], list[str]]


def rule_verdict(events: Column) -> Column:
    """Default scorer, no model: a failure event, an allocation that never
    registered, or a registration undone at once makes a sequence anomalous."""
    bad = (
        tx.contains_any(events, fv.FAILURE_EVENTS)
        | (F.array_contains(events, "E22") & ~F.array_contains(events, "E26"))
        | F.exists(sq.pair_flags(events, "E26", "E23"), lambda hit: hit)
    )
    return F.when(bad, "anomalous").otherwise("normal")


def score(rows: DataFrame, scorer: Scorer | None = None, text: str = "content", output: str = "verdict") -> DataFrame:
    """Add the scorer's text per row. The scorer gets Arrow batches of texts on
    the executors; without one the rule on ``sequence`` stays in the JVM."""
    if scorer is None:
        return rows.withColumn(output, rule_verdict(F.col("sequence")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: scorer(batch[text].tolist())})

    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.StringType())])
    return rows.mapInPandas(run, schema)


def score_and_generate(
    rows: DataFrame,
    scorer: Scorer | None,
    generator: Callable[[str], str],
    retries: int = 3,
    wait: float = 4.0,
    parallel: int = 1,
    per_second: float = 0.0,
    ledger: str | None = None,
) -> DataFrame:
    """Verdict, prediction and answer of every row in one step, so neither hook sees a
    row twice. ``rows`` has ``content`` and ``prompt``, and ``verdict`` if there is no scorer.
    Calls are made as in :func:`generate`."""
    new = [T.StructField("prediction", T.IntegerType()), T.StructField("answer", T.StringType())]
    if scorer is not None:
        new.insert(0, T.StructField("verdict", T.StringType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(generator, retries, wait, parallel, per_second, ledger)
        for batch in batches:
            if scorer is not None:
                batch = batch.assign(verdict=scorer(batch["content"].tolist()))
            bad = [int("anomalous" in (v or "").lower()) for v in batch["verdict"]]
            answers = caller.answers([p if b else None for p, b in zip(batch["prompt"], bad)])
            yield batch.assign(prediction=bad, answer=answers)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *new]))


def generate(
    rows: DataFrame,
    generator: Callable[[str], str],
    prompt: str = "prompt",
    output: str = "explanation",
    retries: int = 3,
    wait: float = 4.0,
    parallel: int = 1,
    per_second: float = 0.0,
    ledger: str | None = None,
) -> DataFrame:
    """Add one generated text per row. A call is tried ``retries`` times with a
    growing wait; after that the text is null and the gate rejects the row.

    A task has up to ``parallel`` calls under way (the generator must allow for threads)
    and starts at most ``per_second`` of them. ``ledger`` is a shared folder of answers:
    a task or job that runs again makes no call twice whose answer came.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(generator, retries, wait, parallel, per_second, ledger)
        for batch in batches:
            yield batch.assign(**{output: caller.answers(batch[prompt].tolist())})

    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.StringType())])
    return rows.mapInPandas(run, schema)


def prediction(verdict: Column) -> Column:
    return F.contains(F.lower(verdict), F.lit("anomalous")).cast("int")


def anomalies(scored: DataFrame) -> DataFrame:
    return scored.filter("prediction = 1")


def first_to_explain(rows: DataFrame, order: str, limit: int = 0) -> DataFrame:
    """The first rows by source order; 0 means all of them."""
    return rows.orderBy(order).limit(limit) if limit else rows


def parsed_reply(reply: Column) -> Column:
    """``{status, explanation}`` of a JSON reply; anything else is ``Unknown``.

    Spark's JSON reader accepts text after an object, so the reply is read as an
    array of exactly one object.
    """
    bare = tx.strip(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    found = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), T.ArrayType(schemas.REPLY))
    one = F.get(found, 0)
    good = (F.size(found) == 1) & one["status"].isNotNull() & one["explanation"].isNotNull()
    return F.when(good, one).otherwise(F.struct(F.lit("Unknown").alias("status"), bare.alias("explanation")))


def verdicts(scored: DataFrame, explanation: Column) -> DataFrame:
    """Request results: a fixed text for normal blocks, else the explanation."""
    bad = F.col("prediction") == 1
    return scored.select(
        "block_id",
        F.when(bad, "Anomalous").otherwise("Normal").alias("status"),
        F.when(bad, explanation).otherwise(fv.NORMAL_REPLY).alias("explanation"),
    )


def extracted(output: Column) -> Column:
    return after_marker(output)
