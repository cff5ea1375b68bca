"""Facts of whole blocks from sessions, also where a huge block is in parts.

Every fact is a sum, a minimum, a maximum or a "first few" over parts. Parts are
reduced where they are and only their facts are grouped by block, so the events
of a hot block never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft import fixed_values as fv
from logweft.functions import sequences as sq

_KEPT = ["block_id", "length", "n_failures", "failures", "n_context", "context", "norm_cycles", "imm_inval"]
_KEPT += ["alloc_no_reg", "serve_count", "lookup_misses", "first_fail_pos", "last_fail_pos", "pre_fail_normal"]
_KEPT += ["first_allocation", "first_registration", "time_insight", "latency"]
_SIGNAL = "array<struct<pos:bigint,event:string>>"


def _aligned(rows: DataFrame) -> DataFrame:
    whole = lambda name: F.col(name).cast("bigint").alias(name)
    texts = {"block_id", "time_insight", "latency", "imm_inval", "alloc_no_reg"}
    lists = {"failures", "context"}
    return rows.select(
        *[F.col(c) if c in texts else F.col(c).cast(_SIGNAL).alias(c) if c in lists else whole(c) for c in _KEPT]
    )


def _part_facts(split: DataFrame) -> DataFrame:
    """One row of facts per part, positions counted from the block's start."""
    events, at = F.col("sequence"), F.col("first_pos")
    nexts = split.filter("part > 0").select(
        "block_id", (F.col("part") - 1).alias("part"), F.slice("sequence", 1, 1).alias("_next")
    )
    # Pairs may straddle two parts, so the first event of the next part is seen too.
    rows = split.join(nexts, ["block_id", "part"], "left").withColumn(
        "_more", F.concat("sequence", F.coalesce("_next", F.array().cast("array<string>")))
    )
    more = F.col("_more")

    def placed(wanted: list[str]) -> Column:
        return F.transform(sq.members(events, wanted), lambda m: F.struct((m["pos"] + at).alias("pos"), m["event"].alias("event")))

    failures, context = placed(fv.FAILURE_EVENTS), placed(fv.CONTEXT_EVENTS)
    local_first = F.get(sq.members(events, fv.FAILURE_EVENTS), 0)["pos"]
    normal = lambda items: F.size(F.filter(items, lambda e: e.isin(fv.NORMAL_BEFORE_FAILURE)))
    place = lambda event: F.nullif(F.array_position(events, event), F.lit(0)) - 1 + at
    return rows.select(
        "block_id",
        "part",
        "first_pos",
        "n_events",
        "latency",
        F.size(failures).alias("n_failures"),
        F.slice(failures, 1, sq.SHOWN).alias("failures"),
        F.get(failures, F.size(failures) - 1)["pos"].alias("last_fail_pos"),
        F.size(context).alias("n_context"),
        F.slice(context, 1, sq.SHOWN).alias("context"),
        sq.pair_count(more, "E11", "E9").alias("norm_cycles"),
        F.exists(sq.pair_flags(more, "E26", "E23"), lambda hit: hit).alias("imm_inval"),
        sq.count_of(events, "E3").alias("serve_count"),
        sq.count_of(events, "E20").alias("lookup_misses"),
        normal(events).alias("_normal"),
        normal(F.slice(events, 1, F.coalesce(local_first, F.lit(0)))).alias("_normal_before"),
        place("E22").alias("first_allocation"),
        place("E26").alias("first_registration"),
        sq.max_gap_before(events, F.col("gaps"), fv.CLEANUP_EVENTS).alias("_cleanup_gap"),
        F.array_max("gaps").alias("_max_gap"),
    )


def _first_few(parts: DataFrame, name: str) -> DataFrame:
    """The first signals of each block: at most three parts can hold them, and
    Spark drops the others before the shuffle (window group limit)."""
    early = Window.partitionBy("block_id").orderBy("part")
    top = parts.filter(F.size(name) > 0).select("block_id", "part", name)
    top = top.withColumn("_rank", F.row_number().over(early)).filter(F.col("_rank") <= sq.SHOWN)
    gathered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", name))), lambda p: p[name]))
    return top.groupBy("block_id").agg(F.slice(gathered, 1, sq.SHOWN).alias(name))


def _merged(split: DataFrame) -> DataFrame:
    parts = _part_facts(split)
    first = F.get(F.col("failures"), 0)["pos"]
    totals = parts.groupBy("block_id").agg(
        F.max("n_events").alias("length"),
        F.max("latency").alias("latency"),
        *[F.sum(c).alias(c) for c in ("n_failures", "n_context", "norm_cycles", "serve_count", "lookup_misses")],
        F.bool_or("imm_inval").alias("imm_inval"),
        F.min(first).alias("first_fail_pos"),
        F.max("last_fail_pos").alias("last_fail_pos"),
        *[F.min(c).alias(c) for c in ("first_allocation", "first_registration")],
        F.max("_cleanup_gap").alias("_cleanup_gap"),
        F.max("_max_gap").alias("_max_gap"),
        F.min(F.when(F.col("n_failures") > 0, F.col("part"))).alias("_fail_part"),
    )
    # Normal events up to the first failure: whole parts before it, and a bit of its own.
    before = (
        parts.join(totals.select("block_id", "_fail_part"), "block_id")
        .groupBy("block_id")
        .agg(
            F.coalesce(
                F.sum(
                    F.when(F.col("part") < F.col("_fail_part"), F.col("_normal")).when(
                        F.col("part") == F.col("_fail_part"), F.col("_normal_before")
                    )
                ),
                F.lit(0),
            ).alias("pre_fail_normal")
        )
    )
    none = F.array().cast(_SIGNAL)
    joined = totals.join(before, "block_id")
    for name in ("failures", "context"):
        joined = joined.join(_first_few(parts, name), "block_id", "left").withColumn(name, F.coalesce(name, none))
    c = F.col
    return joined.withColumns(
        {
            "alloc_no_reg": c("first_allocation").isNotNull() & c("first_registration").isNull(),
            "time_insight": sq.insight(c("length"), c("length"), c("_cleanup_gap"), c("_max_gap"), c("latency")),
        }
    )


def block_facts(session_rows: DataFrame) -> DataFrame:
    """One row of facts per block. ``session_rows`` has ``gaps`` and is read more
    than once where blocks are in parts: pass a stored table."""
    whole = session_rows.filter("parts = 1")
    facts = whole.withColumns(sq.features(F.col("sequence"), F.col("gaps"), F.col("latency")))
    return _aligned(facts).unionByName(_aligned(_merged(session_rows.filter("parts > 1"))))
