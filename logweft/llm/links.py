"""Connected components of links, as alternating star joins on stored tables.

A large-star step hangs every greater neighbour of a node on the least node it knows
of; a small-star step does the same for the lesser ones. Links never grow in number,
every round is stored in the shared folder, and the rounds end when a round changes
nothing: then each node hangs on the least node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweft.session import materialize

BLOCK_LINKS = 200_000  # links that a task joins up in memory before it passes them on


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with at most one link a node: (node, least node)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = np.minimum(root, root[root])
        if np.array_equal(root, before):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) joined up within each task, in blocks of bounded size."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed_on() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= BLOCK_LINKS:
                yield passed_on()
        if held:
            yield passed_on()

    return links.select("a", "b").mapInArrow(step, "a bigint, b bigint")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for every node with a link.

    ``links`` has non-null longs a and b. Repeated, reversed and self links are allowed.
    """
    ordered = thinned(links.filter("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(ordered.distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = materialize(hung.union(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        links, before, state = after, state, _state(after)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
