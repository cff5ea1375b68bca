"""Training-set curation: dedup, sampling, resume, union, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweft import fixed_values as fv
from logweft.functions import sequences as sq, text as tx
from logweft.operators.ranking import hash_cells, keep_first, rank_rows, seeded_hash
from logweft.session import materialize


def usable(sampled: DataFrame, low: int = fv.MIN_SEQUENCE, high: int = fv.MAX_SEQUENCE) -> DataFrame:
    return sampled.filter(sq.length_between(F.col("sequence"), low, high))


def first_of_each_sequence(rows: DataFrame, order: str | Column) -> DataFrame:
    """The first row of every distinct event sequence."""
    keyed = rows.withColumn("fingerprint", sq.fingerprint(F.col("sequence")))
    return keep_first(keyed, ["fingerprint"], F.col(order) if isinstance(order, str) else order)


def sample_rows(rows: DataFrame, n: int = fv.SAMPLE_SIZE, seed: int = fv.SAMPLE_SEED, key: str = "block_id") -> DataFrame:
    """``n`` rows by seeded hash: those ranked below ``n``, whatever ``n`` is. Ranks come
    from cells of the hash, so no task sorts or gathers the sample."""
    hashed = rows.withColumn("_h", seeded_hash(seed, key))
    ranked = rank_rows(hashed, "_rank", hash_cells("_h"), ["_h", key], store=True)
    return ranked.filter(F.col("_rank") < n).drop("_h", "_rank")


def processed_ids(*outputs: DataFrame) -> DataFrame:
    """Block ids in earlier outputs: from the id field, else from the first
    ``Block:`` line of the user message."""
    ids = []
    for rows in outputs:
        own = F.col("block_id") if "block_id" in rows.columns else F.lit(None).cast("string")
        user = F.get(F.col("messages"), 1)["content"]
        told = F.nullif(F.regexp_extract(user, r"(?m)^Block:(.*)$", 1), F.lit(""))
        ids.append(rows.select(F.coalesce(own, tx.strip(told)).alias("block_id")))
    union = ids[0]
    for more in ids[1:]:
        union = union.unionByName(more)
    return union.filter("block_id IS NOT NULL").distinct()


def remaining(sample: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of a sample not processed yet.

    The earlier output may be huge, so it is first cut to ids of the sample, which is
    stored as it is read twice. Either side is broadcast only if Spark measures it as
    small enough.
    """
    sample = materialize(sample, "sample")
    hit = done.join(sample.select("block_id"), "block_id", "left_semi").select("block_id")
    return sample.join(hit, "block_id", "left_anti")


def union_in_order(first: DataFrame, second: DataFrame, order: str | Column) -> DataFrame:
    """Both files with ``source_order``: all of the first before the second."""
    at = F.col(order) if isinstance(order, str) else order
    tag = lambda rows, i: rows.withColumn("source_order", F.struct(F.lit(i).alias("file"), at.alias("at")))
    return tag(first, 0).unionByName(tag(second, 1))


def first_of_each_text(rows: DataFrame, text: str) -> DataFrame:
    """Keep-first on the exact text. The text is the grouping key itself, so
    equality is exact and it is shuffled once per task and text."""
    return keep_first(rows, [text], F.col("source_order"))


def recovered_type(user: Column) -> Column:
    """Text after the first ``Anomaly Type:`` line start; ``unknown`` without one."""
    has = user.rlike(r"(?m)^Anomaly Type:")
    return F.when(has, tx.strip(F.regexp_extract(user, r"(?m)^Anomaly Type:(.*)$", 1))).otherwise("unknown")


def split_rows(
    rows: DataFrame, key: str, validation: float = 0.1, seed: int = fv.SAMPLE_SEED, store: bool = False
) -> DataFrame:
    """Seeded shuffle position and an exact train/val cut.

    Positions come from hash-prefix cells, so the shuffle of all rows is a
    spread-out partial sort rather than one ordered partition.
    """
    if store:
        rows = materialize(rows, "to-split")
    hashed = rows.withColumn("_h", seeded_hash(seed, key))
    ranked = rank_rows(hashed, "position", hash_cells("_h"), ["_h"])
    n_train = rows.agg(F.floor(F.count(F.lit(1)) * F.lit(1 - validation))).scalar()
    return ranked.drop("_h").withColumn("split", F.when(F.col("position") < n_train, "train").otherwise("val"))
