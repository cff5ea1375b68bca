"""Sessions: the ordered event sequence and latency of every block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweft.functions import text as tx
from logweft.operators.ranking import range_numbered
from logweft.operators.templates import Template, text_of
from logweft.session import materialize

# A block of more events is put in order in parts of this size, so no sort grows
# with the hottest block. ``sessions`` joins the parts to one row again;
# ``session_parts`` leaves them, for facts and windows that need no whole row.
PART_EVENTS = 50_000

_NO_TIME = 9223372036854775807


def _clock(ts: Column) -> Column:
    """Seconds as the sort value; missing time goes last."""
    return F.coalesce(tx.clock_seconds(ts), F.lit(_NO_TIME))


def _latency(first: Column, last: Column, timed: Column) -> Column:
    return F.when(timed >= 2, tx.seconds_between(first, last)).otherwise(F.lit(0.0))


def _stats() -> list[Column]:
    return [
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        F.count("ts").alias("_timed"),
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.struct("file_key", "block_start", "line_id")).alias("first_seen"),
    ]


def named(ords: Column, templates: list[Template] | None) -> Column:
    """Event ids at matched ordinals."""
    if templates is None:
        return ords
    ids = F.array(*[F.lit(t.event_id) for t in templates])
    return F.transform(ords, lambda i: F.get(ids, i.cast("int")))


def _gaps(clocks: Column, before: Column) -> Column:
    """Seconds since the previous event; 0.0 where there is none or a time is
    missing. ``before`` is the time in front of the first event."""
    timed = F.transform(clocks, lambda c: F.nullif(c, F.lit(_NO_TIME)))
    return F.transform(
        clocks,
        lambda c, i: F.coalesce(
            (F.get(timed, i) - F.when(i == 0, F.nullif(before, F.lit(_NO_TIME))).otherwise(F.get(timed, i - 1))).cast("double"),
            F.lit(0.0),
        ),
    )


def oversized_blocks(occurrences: DataFrame, part_events: int = PART_EVENTS) -> DataFrame:
    counts = occurrences.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > part_events).select("block_id")


def _whole_blocks(occurrences: DataFrame) -> DataFrame:
    """One shuffle: the block's events and its latency from the same aggregate."""
    grouped = occurrences.groupBy("block_id").agg(
        F.array_sort(
            F.collect_list(F.struct(_clock(F.col("ts")).alias("at"), "file_key", "block_start", "line_id", "ord"))
        ).alias("_ev"),
        *_stats(),
    )
    return grouped.select(
        "block_id",
        F.lit(0).cast("bigint").alias("part"),
        F.lit(1).cast("bigint").alias("parts"),
        F.lit(0).cast("bigint").alias("first_pos"),
        "n_events",
        F.col("_ev.ord").alias("_ords"),
        F.col("_ev.at").alias("_at"),
        F.lit(None).cast("bigint").alias("_before"),
        _latency(F.col("_first"), F.col("_last"), F.col("_timed")).alias("latency"),
        F.col("_first").alias("first_ts"),
        "first_seen",
    )


EVENT_ORDER = ("_at", "file_key", "block_start", "line_id")


def numbered_events(occurrences: DataFrame) -> DataFrame:
    """Every event with its 0-based position in its block, for blocks of any size: ranges
    are cut by a sample of the events' own order, so no task has a whole hot block, nor a
    hot second of it."""
    return range_numbered(occurrences.withColumn("_at", _clock(F.col("ts"))), "pos", EVENT_ORDER, ["block_id"])


def _blocks_in_parts(occurrences: DataFrame, part_events: int) -> DataFrame:
    """Rows of at most ``part_events`` events. Groups are (block, part), so a hot
    block is spread; its totals come from a partial aggregate."""
    numbered = materialize(numbered_events(occurrences), "numbered").withColumn("part", F.floor(F.col("pos") / part_events))
    parts = numbered.groupBy("block_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ord", F.col("_at").alias("at")))).alias("_ev")
    )
    tails = numbered.filter(F.col("pos") % part_events == part_events - 1).select(
        "block_id", (F.col("part") + 1).alias("part"), F.col("_at").alias("_before")
    )
    stats = occurrences.groupBy("block_id").agg(*_stats())
    return parts.join(tails, ["block_id", "part"], "left").join(stats, "block_id").select(
        "block_id",
        "part",
        F.ceil(F.col("n_events") / part_events).alias("parts"),
        (F.col("part") * part_events).alias("first_pos"),
        "n_events",
        F.col("_ev.ord").alias("_ords"),
        F.col("_ev.at").alias("_at"),
        "_before",
        _latency(F.col("_first"), F.col("_last"), F.col("_timed")).alias("latency"),
        F.col("_first").alias("first_ts"),
        "first_seen",
    )


def _parted(occurrences: DataFrame, part_events: int, sizes: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of whole blocks, rows of parts or None). One counting pass finds oversized
    blocks; their ids are stored, and with any of them the occurrences as well, since
    several passes follow. Without ``sizes`` they are stored first, and counted there."""
    stored = sizes is None or sizes is occurrences
    if sizes is None:
        occurrences = sizes = materialize(occurrences, "occurrences")
    big = materialize(oversized_blocks(sizes, part_events), "oversized")
    if big.isEmpty():
        return _whole_blocks(occurrences), None
    if not stored:
        occurrences = materialize(occurrences, "occurrences")
    small = occurrences.join(big, "block_id", "left_anti")
    large = occurrences.join(big, "block_id", "left_semi")
    return _whole_blocks(small), _blocks_in_parts(large, part_events)


def _assembled(parts: DataFrame) -> DataFrame:
    """One row per block from its ordered parts."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "_ords", "_at")))
    rows = parts.groupBy("block_id").agg(
        pieces.alias("_pieces"), *[F.any_value(c).alias(c) for c in ("n_events", "latency", "first_ts", "first_seen")]
    )
    return rows.select(
        "block_id",
        F.lit(0).cast("bigint").alias("part"),
        F.lit(1).cast("bigint").alias("parts"),
        F.lit(0).cast("bigint").alias("first_pos"),
        "n_events",
        F.flatten(F.transform("_pieces", lambda p: p["_ords"])).alias("_ords"),
        F.flatten(F.transform("_pieces", lambda p: p["_at"])).alias("_at"),
        F.lit(None).cast("bigint").alias("_before"),
        "latency",
        "first_ts",
        "first_seen",
    )


def _named(rows: DataFrame, templates: list[Template] | None, with_text: bool, with_gaps: bool) -> DataFrame:
    columns = [
        "block_id",
        "part",
        "parts",
        "first_pos",
        "n_events",
        named(F.col("_ords"), templates).alias("sequence"),
    ]
    if with_gaps:
        columns.append(_gaps(F.col("_at"), F.col("_before")).alias("gaps"))
    result = rows.select(*columns, "latency", "first_ts", "first_seen")
    if with_text:
        result = result.withColumn("text_sequence", text_sequence(templates, F.col("sequence")))
    return result


def sessions(
    occurrences: DataFrame,
    templates: list[Template] | None,
    part_events: int | None = None,
    with_text: bool = False,
    with_gaps: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per block of any size, events in order.

    Order is time, then source position; events without a time come last.
    Oversized blocks are ordered in parts over many tasks and only then joined to
    the row that is asked for. ``sizes`` makes the counting pass cheap: any frame
    with a ``block_id`` column whose rows per block are no fewer than the
    occurrences, such as the lines before template matching, or the occurrences
    themselves where they are stored already. Without ``templates``, ``ord`` already
    is the event id.
    """
    whole, parts = _parted(occurrences, part_events or PART_EVENTS, sizes)
    rows = whole if parts is None else whole.unionByName(_assembled(parts))
    return _named(rows, templates, with_text, with_gaps)


def session_parts(
    occurrences: DataFrame,
    templates: list[Template] | None,
    part_events: int | None = None,
    with_text: bool = False,
    with_gaps: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """As ``sessions``, but an oversized block stays in rows of ``part_events`` events
    (``part`` of ``parts``, from ``first_pos`` on), for what can merge parts itself."""
    whole, parts = _parted(occurrences, part_events or PART_EVENTS, sizes)
    rows = whole if parts is None else whole.unionByName(parts)
    return _named(rows, templates, with_text, with_gaps)


def session_heads(
    occurrences: DataFrame,
    templates: list[Template] | None,
    most: int,
    part_events: int | None = None,
    with_text: bool = False,
    with_gaps: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per block with its first ``most`` events, and the count, latency and times
    of all. Of an oversized block only the parts that hold those events are joined, so a
    row has at most ``most`` events: what packing, truncated contents and previews need.
    """
    whole, parts = _parted(occurrences, part_events or PART_EVENTS, sizes)
    left = (F.lit(most) - F.col("first_pos")).cast("int")
    cut = lambda rows: rows.filter(left > 0).withColumns({c: F.slice(c, F.lit(1), left) for c in ("_ords", "_at")})
    rows = cut(whole) if parts is None else cut(whole).unionByName(_assembled(cut(parts)))
    return _named(rows, templates, with_text, with_gaps)


def text_sequence(templates: list[Template], sequence: Column) -> Column:
    """Template texts beside the ids: looked up after the shuffle, never shuffled."""
    return F.transform(sequence, lambda event: text_of(templates, event))


def event_matrix(occurrences: DataFrame, templates: list[Template]) -> DataFrame:
    """One row per block, one count column per event id of the vocabulary."""
    counts = [
        F.count_if(F.col("ord") == i).alias(t.event_id) for i, t in enumerate(templates)
    ]
    return occurrences.groupBy("block_id").agg(*counts)


def sparse_event_matrix(occurrences: DataFrame) -> DataFrame:
    """One row per block for vocabularies of any size: ``ords``, the template numbers it has
    in ascending order, and ``counts`` beside them. Events are shuffled once, summed up
    before; what follows is a row per block and distinct event."""
    counted = occurrences.groupBy("block_id", "ord").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("_cells"))
    return rows.select("block_id", F.col("_cells.ord").alias("ords"), F.col("_cells.n").alias("counts"))


def preview(session_rows: DataFrame, n: int = 3) -> DataFrame:
    """The first sessions in order of first appearance in the source."""
    return session_rows.orderBy("first_seen").limit(n)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop a pipeline early when a stage produced nothing."""
    if df.isEmpty():
        raise ValueError(f"no {what}: check the input paths and the template vocabulary")
    return df
