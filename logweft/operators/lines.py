"""From raw lines to event occurrences, with a reason for every line left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweft.functions import text as tx
from logweft.operators.templates import Template, id_of, text_of, with_match


def mark_lines(lines: DataFrame, templates: list[Template]) -> DataFrame:
    """Add ``block_id``, ``ord`` and ``reason``. The costly template search runs
    only on lines that have a block id."""
    found = lines.withColumn("value", tx.clean_line(F.col("value"))).withColumn("block_id", tx.block_id(F.col("value")))
    matched = with_match(found, templates, F.col("block_id").isNotNull())
    return matched.withColumn(
        "reason",
        F.when(F.col("value") == "", "blank")
        .when(F.col("block_id").isNull(), "no_block")
        .when(F.col("ord").isNull(), "unmatched")
        .otherwise("matched"),
    )


def line_blocks(lines: DataFrame) -> DataFrame:
    """Block ids of lines, matched or not: an upper bound of events per block
    that needs no template search."""
    return lines.select(tx.block_id(F.col("value")).alias("block_id")).filter("block_id IS NOT NULL")


def matched_events(marked: DataFrame) -> DataFrame:
    """Matched lines as occurrences: block, time, template ordinal, source position."""
    return marked.filter(F.col("ord").isNotNull()).select(
        "block_id",
        tx.log_time(F.col("value")).alias("ts"),
        F.col("ord").cast("smallint").alias("ord"),
        "file_key",
        "block_start",
        "line_id",
    )


def events(lines: DataFrame, templates: list[Template]) -> DataFrame:
    return matched_events(mark_lines(lines, templates))


def named_events(occurrences: DataFrame, templates: list[Template]) -> DataFrame:
    """Occurrences with event id and template text spelled out."""
    named = occurrences.withColumn("event_id", id_of(templates, F.col("ord").cast("int")))
    return named.withColumn("text", text_of(templates, F.col("event_id")))


def parse_counters(marked: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals. ``total`` includes blank lines."""
    block = F.when(F.col("reason") == "matched", F.col("block_id"))
    blocks = F.approx_count_distinct(block) if approximate else F.count_distinct(block)
    count = lambda reason: F.count_if(F.col("reason") == reason).alias(reason)
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        count("blank"),
        count("no_block"),
        count("unmatched"),
        count("matched"),
        blocks.alias("unique_blocks"),
    )


SKETCH_BITS = 14  # 2**14 registers: a relative standard error of about 0.8 %
SKETCH_ERROR = 0.03  # more than three standard errors


def daily_counters(occurrences: DataFrame) -> DataFrame:
    """A row per day (null for events without a time) to store: ``n_events`` and a sketch of
    the distinct blocks, which add up over days without their blocks."""
    day = F.to_date("ts")
    return occurrences.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.hll_sketch_agg("block_id", SKETCH_BITS).alias("blocks")
    )


def counters_between(stored: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row for the days from ``first`` to ``last``, from stored rows alone: events
    exactly, distinct blocks within ``SKETCH_ERROR`` (0 if there are no days)."""
    days = stored.filter(F.col("day").between(first, last))
    return days.agg(
        F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("blocks")), F.lit(0)).alias("unique_blocks"),
    )
