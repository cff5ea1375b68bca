"""Classifier samples: masked content, keep-first dedup, class balancing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logweft import fixed_values as fv
from logweft.functions import text as tx
from logweft.operators.ranking import hash_cells, keep_first, rank_rows, seeded_hash
from logweft.session import materialize


def join_messages(messages: Column) -> Column:
    return F.array_join(messages, fv.MESSAGE_JOIN)


def content_of_text(text: Column) -> Column:
    """A list kept as text: quoted items joined, anything else split on commas."""
    quoted = text.rlike(r"(?s)^\s*\[\s*(?:'[^']*'\s*(?:,\s*'[^']*'\s*)*)?\]\s*$")
    items = F.transform(
        F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1)), lambda item: item
    )
    return F.when(quoted, join_messages(items)).otherwise(F.replace(text, F.lit(","), F.lit(fv.MESSAGE_JOIN)))


def unlabelled(contents: DataFrame) -> DataFrame:
    return contents.withColumn("label", F.lit(0))


def prepare(samples: DataFrame, order: Column | None = None) -> DataFrame:
    """Masked ``content`` and its ``messages``. With ``order``, only the first
    sample of each masked content stays."""
    masked = samples.withColumn("content", tx.mask_parameters(F.col("content")))
    if order is not None:
        masked = keep_first(masked, ["content"], order)
    return masked.withColumn("messages", F.split("content", fv.MESSAGE_JOIN, -1))


def class_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("anomalous")
    )


@dataclass(frozen=True)
class BalancePlan:
    """Sizes of a balanced resample."""

    minority_label: int
    n_minority: int
    n_majority: int
    minority_target: int
    total: int

    @property
    def combined(self) -> int:
        return self.n_majority + self.minority_target


def balance_plan(
    normal: int,
    anomalous: int,
    target_ratio: float = 0.3,
    max_samples: int | None = None,
    min_samples: int = 50_000,
) -> BalancePlan:
    """The rarer class is raised to ``target_ratio``; on a tie normal counts as
    the rarer one. ``min_samples`` applies only without ``max_samples``."""
    label = 1 if anomalous < normal else 0
    rare, common = sorted((normal, anomalous))
    if rare == 0:
        raise ValueError("balancing needs samples of both classes")
    target = max(int(target_ratio * common / (1 - target_ratio)), rare)
    total = target + common
    if max_samples is not None:
        if max_samples > total:
            raise ValueError("max_samples exceeds the balanced size")
        total = max_samples
    else:
        total = max(total, min_samples)
    return BalancePlan(label, rare, common, target, total)


def plan_for(samples: DataFrame, **options) -> BalancePlan:
    counts = class_counts(samples).first()
    return balance_plan(counts.normal, counts.anomalous, **options)


def _ranked(rows: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    """Add ``_rank``, the place in a seeded shuffle. Rows are ranked inside
    hash-prefix cells, so no task sees more than its cell."""
    hashed = rows.withColumn("_h", seeded_hash(seed, *ids))
    return rank_rows(hashed, "_rank", hash_cells("_h"), ["_h"]).drop("_h")


COPIES_A_ROW = 256  # that one row is repeated before it is dealt to tasks again


def repeated(rows: DataFrame, times: Column, most: int, name: str) -> DataFrame:
    """Each row ``times`` times, at most ``most``, numbered from 1 in ``name``. Where a row
    can have many copies, it first becomes one row per ``COPIES_A_ROW`` of them and these
    are dealt out evenly, so the copies of one row are made in as many tasks as there are."""
    if most <= COPIES_A_ROW:
        return rows.withColumn(name, F.explode(F.sequence(F.lit(1), times.cast("int"))))
    chunks = F.sequence(F.lit(0), F.ceil(times / COPIES_A_ROW).cast("int") - 1)
    chunked = rows.withColumn("_times", times.cast("int")).withColumn("_chunk", F.explode(chunks))
    spread = chunked.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in chunked.columns]))
    low = F.col("_chunk") * COPIES_A_ROW + 1
    numbers = F.sequence(low, F.least(low + (COPIES_A_ROW - 1), F.col("_times")))
    return spread.withColumn(name, F.explode(numbers)).drop("_times", "_chunk")


def oversample(samples: DataFrame, plan: BalancePlan, seed: int = 42, id_column: str = "id") -> DataFrame:
    """All majority rows, and the minority repeated to its target: whole copies
    of every row, then one more of a seeded choice."""
    rare = samples.filter(F.col("label") == plan.minority_label)
    common = samples.filter(F.col("label") != plan.minority_label)
    whole, extra = divmod(plan.minority_target, plan.n_minority)
    copies = F.lit(whole)
    if extra:
        rare = _ranked(rare, seed, [id_column])
        copies = copies + F.when(F.col("_rank") < extra, 1).otherwise(0)
    copied = repeated(rare, copies, whole + 1, "copy")
    return common.withColumn("copy", F.lit(1)).unionByName(copied.drop("_rank"))


def balanced(samples: DataFrame, plan: BalancePlan, seed: int = 42, id_column: str = "id") -> DataFrame:
    """Exactly ``plan.total`` rows: a seeded choice when that is fewer than the
    oversampled set, else whole tiles of it plus a seeded choice of tiled rows.

    ``copy``, ``tile`` and ``again`` tell repeated rows apart; ``shuffle_key`` is
    the seeded order, to sort by only where order matters.
    """
    combined = materialize(oversample(samples, plan, seed, id_column), "oversampled")
    ids = [id_column, "copy", "tile"]
    whole, extra = divmod(plan.total, plan.combined)
    tiled = repeated(combined, F.lit(max(whole, 1)), whole, "tile")
    again = F.array(F.lit(0))
    if extra:
        tiled = _ranked(tiled, seed + 1, ids)
        chosen = F.col("_rank") < extra
        if whole == 0:
            tiled = tiled.filter(chosen)
        else:
            again = F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(again)
    resized = tiled.withColumn("again", F.explode(again)).drop("_rank")
    return resized.withColumn("shuffle_key", seeded_hash(seed + 2, *ids, "again"))
