"""Running totals, ranks and keep-first that hold when one group is huge.

A plain ``row_number() over (partition by key order by ...)`` sends a whole
group to one task. Here every group is cut into *cells*: coarse values of the
sort key that follow its order (a line range, a file, a hash prefix). Each task
then sorts one cell of one group, and a cell's start value comes from a small
table of per-cell sums, made with map-side partial aggregation. Where no such cells are
known, ``ranged`` cuts ranges at sampled sort values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft.session import materialize

LINE_CELL_BITS = 16
HASH_CELL_CHARS = (3, 6)


def line_cells(line_id: str = "line_id") -> list[Column]:
    """Cells for a unique, non-negative long: at most 2**16 rows each."""
    return [F.shiftright(line_id, 2 * LINE_CELL_BITS), F.shiftright(line_id, LINE_CELL_BITS)]


def source_cells() -> list[Column]:
    """Cells for rows that carry a source position (see ``sources.logs``): a file,
    then a stretch of one split of it."""
    return [
        F.col("file_key"),
        F.struct("file_key", "block_start", F.shiftright("line_id", LINE_CELL_BITS)),
    ]


SOURCE_ORDER = ("file_key", "block_start", "line_id")


def source_order() -> Column:
    return F.struct(*SOURCE_ORDER)


def hash_cells(hash_column: str) -> list[Column]:
    """Cells for an evenly spread hex digest: its first digits. 16**6 cells hold
    some 60 000 rows each at 10**12 rows, and no table of sums is above 16**3 rows."""
    return [F.substring(hash_column, 1, n) for n in HASH_CELL_CHARS]


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    cells: Sequence[Column],
    order: Sequence[str | Column],
    totals: dict[str, Column],
    store: bool = False,
) -> DataFrame:
    """Add inclusive running sums per group, in order.

    ``cells`` go from coarse to fine and must follow ``order``: a row in a lower
    cell sorts before every row of a higher one. Keys and cells are never null. The input is
    read twice, once for the sums of its cells; ``store`` writes it first and
    suits inputs that are costly to derive.
    """
    keys = list(keys)
    levels = [f"_cell{i}" for i in range(len(cells))]
    measures = {f"_m_{t}": m for t, m in totals.items()}
    marked = df.withColumns({name: cell for name, cell in zip(levels, cells)} | measures)
    if store:
        marked = materialize(marked, "ranked")

    # Sums per cell, from the finest level up: each level reads the one below.
    sums = [marked.groupBy(*keys, *levels).agg(*[F.sum(m).alias(m) for m in measures])]
    for depth in range(len(levels) - 1, 0, -1):
        sums.insert(0, sums[0].groupBy(*keys, *levels[:depth]).agg(*[F.sum(m).alias(m) for m in measures]))

    # Start value of each cell: its siblings before it, plus its parent's start.
    starts = None
    for depth, level in enumerate(sums, start=1):
        outer = keys + levels[: depth - 1]
        before = Window.partitionBy(*outer).orderBy(levels[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        here = level.select(
            *keys, *levels[:depth], *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_start") for m in measures]
        )
        if starts is not None:
            parent = starts.withColumnsRenamed({f"{m}_start": f"{m}_parent" for m in measures})
            here = here.join(parent, outer).select(
                *keys,
                *levels[:depth],
                *[(F.col(f"{m}_start") + F.col(f"{m}_parent")).alias(f"{m}_start") for m in measures],
            )
        starts = here

    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumns({f"{m}_run": F.sum(m).over(inside) for m in measures})
    return summed.join(starts, keys + levels).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_m_{t}_run") + F.col(f"_m_{t}_start")).alias(t) for t in totals],
    )


def rank_rows(
    df: DataFrame,
    name: str,
    cells: Sequence[Column],
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    store: bool = False,
) -> DataFrame:
    """Add a 0-based position within each group (or overall without keys)."""
    ranked = running_totals(df, keys, cells, order, {name: F.lit(1).cast("bigint")}, store)
    return ranked.withColumn(name, F.col(name) - 1)


def ranged(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Stored rows in ranges of about equal size over (keys, order), each sorted: ``_range``
    and the ``_place`` in it. Cut points come from Spark's sample of these sort values, so
    a key with most of the rows is cut wherever its rows are dense, whatever its order looks like."""
    by = [*keys, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    return materialize(placed, "ranged")


def range_numbered(df: DataFrame, name: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add a 0-based position within each group (or overall) by a unique ``order``.

    A range's start in a group is the sum of the group's rows in the ranges before it: a
    table with a row per group and range, and a group is in few ranges unless it is large.
    Keys are never null.
    """
    rows = ranged(df, order, keys)
    cells = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*keys, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    numbered = rows.join(starts, [*keys, "_range"])
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_place")).alias(name))


def seeded_hash(seed: int, *ids: str | Column) -> Column:
    """A repeatable random order that no repartitioning changes."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def _first_by_sort(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keep-first on the keys themselves: their whole rows are aggregated, and sorted for it."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


_WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the one lowest in ``order``, which is unique.

    The rows are stored once. What is aggregated is 128 bits of digest and the least
    position, all of fixed width, by hash and in part before the shuffle; the rows come back
    by a semi-join on their numbers. Rows that share a digest with a first row are compared
    with its keys; should any differ, they are kept apart by the keys themselves.
    An order that is no whole number is turned into positions by ranges of it.
    """
    digests = {"_d1": F.xxhash64(*keys), "_d2": F.xxhash64(F.lit("second"), *keys)}
    rows = materialize(df.withColumns({**digests, "_order": order, "_row": F.monotonically_increasing_id()}), "keep-first")
    narrow = rows.select("_d1", "_d2", "_row", "_order")
    if dict(rows.dtypes)["_order"] in _WHOLE_NUMBERS:
        placed = narrow.withColumn("_pos", F.col("_order").cast("bigint"))
    else:
        placed = range_numbered(narrow, "_pos", ["_order"])
    least = placed.groupBy("_d1", "_d2").agg(F.min("_pos").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    firsts = materialize(placed.join(least, ["_d1", "_d2", "_pos"]).select("_row", "_d1", "_d2", "_n"), "firsts")
    kept = rows.join(firsts.select("_row"), "_row", "left_semi")

    repeated = firsts.filter("_n > 1")
    named = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    winners = rows.join(repeated.select("_row"), "_row", "left_semi").select("_d1", "_d2", named.alias("_winner"))
    others = rows.join(firsts.select("_row"), "_row", "left_anti").join(winners, ["_d1", "_d2"])
    collided = others.filter(~F.col("_winner").eqNullSafe(named)).drop("_winner")
    if not collided.isEmpty():
        kept = kept.unionByName(_first_by_sort(collided, keys, F.col("_order")))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
