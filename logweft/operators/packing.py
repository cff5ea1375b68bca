"""Fixed-size batches: numbering, flattening with offsets, splitting, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweft.operators.ranking import rank_rows

BATCH_SIZE = 16
MAX_MESSAGES = 128


def batches(
    rows: DataFrame,
    cells: Sequence[Column],
    order: Sequence[str | Column],
    size: int = BATCH_SIZE,
    store: bool = False,
) -> DataFrame:
    """Number rows in input order and cut the numbering into batches."""
    ranked = rank_rows(rows, "position", cells, order, store=store)
    return ranked.withColumn("batch_id", F.floor(F.col("position") / size))


def label_name(label: Column) -> Column:
    return F.when(label == 0, "normal").when(label == 1, "anomalous").otherwise(label.cast("string"))


def truncate(messages: Column, most: int = MAX_MESSAGES) -> Column:
    return F.slice(messages, 1, most)


def flatten_with_starts(lists: Column) -> tuple[Column, Column]:
    """All items in one array, and where each list but the first begins."""
    starts = F.aggregate(
        lists,
        F.array(F.lit(0)),
        lambda sums, item: F.concat(sums, F.array(F.element_at(sums, -1) + F.size(item))),
    )
    return F.flatten(lists), F.slice(starts, 2, F.greatest(F.size(lists) - 1, F.lit(0)))


def split_at_starts(items: Column, starts: Column) -> Column:
    """Undo :func:`flatten_with_starts`."""
    begins = F.concat(F.array(F.lit(0)), starts)
    ends = F.concat(starts, F.array(F.size(items)))
    pairs = F.arrays_zip(begins.alias("a"), ends.alias("b"))
    return F.transform(pairs, lambda p: F.slice(items, p["a"] + 1, p["b"] - p["a"]))


def pack(batched: DataFrame, most: int = MAX_MESSAGES) -> DataFrame:
    """One row per batch: flat messages, starts and label names. A group holds
    at most one batch of rows."""
    ordered = F.array_sort(
        F.collect_list(F.struct("position", truncate(F.col("messages"), most).alias("m"), label_name(F.col("label")).alias("l")))
    )
    grouped = batched.groupBy("batch_id").agg(ordered.alias("_rows"))
    data, starts = flatten_with_starts(F.col("_rows.m"))
    return grouped.select("batch_id", data.alias("data"), starts.alias("starts"), F.col("_rows.l").alias("labels"))


def pad(lists: Column, filler: Column, left: bool = False) -> tuple[Column, Column]:
    """Lists of one batch brought to equal length, and their 1/0 masks."""
    width = F.array_max(F.transform(lists, F.size))

    def extend(items: Column, fill: Column) -> Column:
        missing = F.array_repeat(fill, width - F.size(items))
        return F.concat(missing, items) if left else F.concat(items, missing)

    padded = F.transform(lists, lambda items: extend(items, filler))
    masks = F.transform(lists, lambda items: extend(F.transform(items, lambda _: F.lit(1)), F.lit(0)))
    return padded, masks


def pad_batches(packed: DataFrame, filler: str = "", left: bool = False) -> DataFrame:
    lists = split_at_starts(F.col("data"), F.col("starts"))
    padded, masks = pad(F.col("_lists"), F.lit(filler), left)
    return packed.withColumn("_lists", lists).select("batch_id", padded.alias("padded"), masks.alias("mask"), "labels")
