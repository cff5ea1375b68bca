"""Embedding near-duplicates through an inverted multi-index.

The two halves of a unit vector have codebooks of their own; pairs of centroids form a
product grid of cells. Every vector lies in the cell of its nearest centroids and visits
the cells nearest to it, in the order of the sum of both squared distances (a cell that
is the i-th in one half and the j-th in the other is never among the first i * j - 1,
which bounds what has to be compared to find them). How many cells it visits is the
least number that finds ``RECALL`` of the links of sampled vectors, which are compared
with all rows, and of planted pairs at the least cosine of a link. What is found is verified by cosine in double precision.

Equal vectors of one label are one row with a count. Where both vectors of a pair visit
each other's cell, the one of lower number counts it; so links are counted without
listing pairs. Crowded cells are cut into blocks that all their visitors come to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm.common import values
from logweft.llm.links import components, forest
from logweft.session import materialize

COSINE = 0.93
RECALL = 0.98  # of the sampled vectors' links
SAMPLE = 8192  # vectors that codebooks are fitted on
QUERIES = 100  # sampled vectors that are compared with all rows at first
MOST_QUERIES = 1600  # of them at once
LINKS = 500  # links to measure, if the sample has so many
PLANTED = 2000  # pairs at COSINE that the least number of visits is taken from
MOST_CENTROIDS = 128  # of a half
PER_CELL = 16  # vectors of a cell that the number of centroids aims at
BLOCK = 2048  # residents of a cell that are compared at once
VISITS = 16  # cells to visit where the sampled vectors have no links


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


def fit_codebook(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means of a bounded sample, from evenly chosen points."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        nearest = _distances(points, centroids).argmin(1)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


class Grid:
    """Two codebooks and the order in which a vector visits the cells of their product."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half = half
        self.books = [fit_codebook(sample[:, :half], k), fit_codebook(sample[:, half:], k)]
        self.width = len(self.books[1])
        self.cells = len(self.books[0]) * self.width

    def _both(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(vectors[:, : self.half], self.books[0]), _distances(vectors[:, self.half :], self.books[1])

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        left, right = self._both(vectors)
        return left.argmin(1) * self.width + right.argmin(1)

    def rank(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many other cells every vector visits before or with its given one."""
        out = np.zeros(len(vectors), np.int64)
        for at in range(0, len(vectors), 64):
            left, right = self._both(vectors[at : at + 64])
            sums = (left[:, :, None] + right[:, None, :]).reshape(len(left), -1)
            own = np.take_along_axis(sums, cells[at : at + 64, None], 1)
            out[at : at + 64] = (sums <= own).sum(1) - 1
        return out

    def visits(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of every vector, nearest first."""
        n = min(n, self.cells)
        left, right = self._both(vectors)
        by_left, by_right = left.argsort(1, kind="stable"), right.argsort(1, kind="stable")
        i, j = np.divmod(np.arange(self.cells), self.width)
        near = (i + 1) * (j + 1) <= n
        i, j = i[near], j[near]
        total = np.take_along_axis(left, by_left[:, i], 1) + np.take_along_axis(right, by_right[:, j], 1)
        first = total.argsort(1, kind="stable")[:, :n]
        return np.take_along_axis(by_left[:, i] * self.width + by_right[:, j], first, 1)


def can_link() -> Column:
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.col("label").isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can have links, and the number of their class of equal vectors."""
    return vectors.filter(can_link()).select("vec_id", "label", "embedding", *[F.xxhash64(F.lit(i), "embedding").alias(f"k{i}") for i in (1, 2)])


def _matrix(batch: pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    return unit(np.array(values(batch, name), dtype=float)) if len(batch) else np.zeros((0, 0))


def _measured_visits(classes: DataFrame, grid: Grid, sample: list) -> int:
    """Cells to visit for RECALL of the sampled vectors' links with all rows, at least
    those for planted pairs. More vectors are compared until ``LINKS`` are measured."""
    own = unit(np.array([q["embedding"] for q in sample], dtype=float))
    reached: dict[int, int] = {}
    start, n = 0, QUERIES
    while start < len(sample) and sum(reached.values()) < LINKS:
        for rank, links in _link_ranks(classes, grid, own[start : start + n], sample[start : start + n]):
            reached[rank] = reached.get(rank, 0) + links
        start, n = start + n, min(4 * n, MOST_QUERIES)
    floor = _planted_visits(grid, own)
    if not reached:
        return max(floor, VISITS)
    ranks = sorted(reached)
    sums = np.cumsum([reached[r] for r in ranks])
    return max(floor, ranks[int(np.searchsorted(sums, RECALL * sums[-1]))] + 1)


def _planted_visits(grid: Grid, vectors: np.ndarray) -> int:
    """Cells to visit for RECALL of pairs at COSINE, made by turning sampled vectors. A pair
    is found from either side."""
    rng = np.random.default_rng(SAMPLE)
    some = vectors[np.linspace(0, len(vectors) - 1, PLANTED).astype(int)]
    aside = rng.normal(size=some.shape)
    aside = aside - (aside * some).sum(1, keepdims=True) * some
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    turned = COSINE * some + np.sqrt(1 - COSINE**2) * aside
    rank = np.minimum(grid.rank(some, grid.cell(turned)), grid.rank(turned, grid.cell(some)))
    return int(np.sort(rank)[int(np.ceil(RECALL * len(rank))) - 1]) + 1


def _link_ranks(classes: DataFrame, grid: Grid, vectors: np.ndarray, queries: list) -> list[tuple[int, int]]:
    """(rank of the linked row's cell among those that a query visits, links)."""
    shared = classes.sparkSession.sparkContext.broadcast(
        (grid, vectors, np.array([q["label"] for q in queries]), np.array([q["class_id"] for q in queries]))
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, vectors, labels, ids = shared.value
        for batch in batches:
            own = _matrix(batch)
            if not len(own):
                continue
            linked = (own @ vectors.T >= COSINE) & (np.array(values(batch, "label"))[:, None] == labels)
            linked &= np.array(values(batch, "class_id"))[:, None] != ids
            row, query = np.nonzero(linked)
            ranks, counts = np.unique(grid.rank(vectors[query], grid.cell(own)[row]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(counts)], names=["rank", "n"])

    found = classes.select("class_id", "label", "embedding").mapInArrow(step, "rank bigint, n bigint")
    return [(r["rank"], r["n"]) for r in found.groupBy("rank").agg(F.sum("n").alias("n")).collect()]


def _placed(classes: DataFrame, grid: Grid, visits: int) -> DataFrame:
    """Every class with its cell and the cells that it visits."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch)
            if not len(vectors):
                continue
            lists = shared.value.visits(vectors, visits)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array(shared.value.cell(vectors).astype(np.int32)),
                    pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())),
                ],
                names=["class_id", "label", "n", "vector", "cell", "visits"],
            )

    kind = dict(classes.dtypes)["label"]
    return classes.select("class_id", "label", "n", "embedding").mapInArrow(
        step, f"class_id bigint, label {kind}, n bigint, vector binary, cell int, visits array<int>"
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by block, residents before visitors: (class, linked vectors, null)
    and (class, null, class it is joined to)."""
    held: list[pa.RecordBatch] = []
    block = None
    residents = None

    def columns(rows: pa.RecordBatch) -> tuple:
        ids, n = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        vectors = np.frombuffer(b"".join(rows.column(3).to_pylist())).reshape(len(rows), -1)
        cells = rows.column(4).to_numpy()
        lists = rows.column(5)
        return ids, n, vectors, cells, lists

    def compare(visitors: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, n, vectors, cells, lists = columns(visitors)
        rids, rn, rvectors, rcells, rlists = residents
        p, r = np.nonzero(vectors @ rvectors.T >= COSINE)
        apart = ids[p] != rids[r]
        p, r = p[apart], r[apart]
        if not len(p):
            return None
        # Does the resident visit the visitor's cell as well? Then the lower number counts the pair.
        both = (rlists[r] == cells[p][:, None]).any(1)
        counted = ~both | (ids[p] < rids[r])
        p, r = p[counted], r[counted]
        if not len(p):
            return None
        mine = np.bincount(p, rn[r], minlength=len(ids)).astype(np.int64)
        theirs = np.bincount(r, n[p], minlength=len(rids)).astype(np.int64)
        a, b = forest(ids[p], rids[r])
        who = np.concatenate([ids[mine > 0], rids[theirs > 0], a])
        links = np.concatenate([mine[mine > 0], theirs[theirs > 0], np.zeros(len(a), np.int64)])
        joined = np.concatenate([np.full((mine > 0).sum() + (theirs > 0).sum(), -1), b])
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(links), pa.array(joined)], names=["a", "links", "b"])

    for batch in batches:
        keys = list(zip(values(batch, "label"), values(batch, "home"), values(batch, "part")))
        visiting = values(batch, "visitor")
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start] and visiting[end] == visiting[start]:
                end += 1
            rows = pa.RecordBatch.from_arrays(
                [batch.column(i).slice(start, end - start) for i in range(6)],
                names=["label", "class_id", "n", "vector", "cell", "visits"],
            )
            if keys[start] != block:
                block, held, residents = keys[start], [], None
            if not visiting[start]:
                held.append(rows)
                parts = [columns(h) for h in held]
                lists = [np.array(p[4].to_pylist(), np.int32) for p in parts]
                residents = (*(np.concatenate([p[i] for p in parts]) for i in range(4)), np.concatenate(lists))
            elif residents is not None:
                for at in range(0, len(rows), BLOCK):
                    if (found := compare(rows.slice(at, BLOCK))) is not None:
                        yield found
            start = end


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """Per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors that are null, zero or hold a null or non-finite component, or have no label,
    link with nothing: they are components of their own. Repeated rows are vectors of
    their own and link with each other. Other columns are not read. All vectors have one
    length, at least two.
    """
    good = usable(vectors)
    grouped = good.groupBy("label", "k1", "k2").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding")
    )
    classes = materialize(grouped.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = classes.filter(F.pmod(F.xxhash64("k1", F.lit(3)), F.lit(1_000_003)) < F.lit(share * 1_000_003)).select(
        "class_id", "label", "embedding", "k1"
    ).collect()
    counts = F.sum("links").alias("links")
    if sample:
        sample.sort(key=lambda r: (r["k1"], r["class_id"]))
        k = int(np.clip(round(np.sqrt(n / PER_CELL)), 2, MOST_CENTROIDS))
        grid = Grid(unit(np.array([r["embedding"] for r in sample], dtype=float)), k)
        visits = _measured_visits(classes, grid, sample)
        placed = materialize(_placed(classes, grid, visits), "vector-cells")
        sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        sizes = sizes.select("label", F.col("cell").alias("home"), "parts")
        own = placed.select("*", F.col("cell").alias("home")).join(sizes, ["label", "home"])
        own = own.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
        calls = placed.select("*", F.explode("visits").alias("home")).join(sizes, ["label", "home"])
        calls = calls.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        order = ["label", "class_id", "n", "vector", "cell", "visits", "home", "part"]
        met = own.select(*order, F.lit(False).alias("visitor")).union(calls.select(*order, F.lit(True)))
        dealt = met.repartition("label", "home", "part").sortWithinPartitions("label", "home", "part", "visitor")
        found = materialize(dealt.mapInArrow(_compared, "a bigint, links bigint, b bigint"), "vector-links")
        links = found.filter("b < 0").groupBy(F.col("a").alias("class_id")).agg(counts)
        roots = components(found.filter("b >= 0").select("a", "b"))
    else:
        links = classes.select("class_id", F.lit(0).cast("bigint").alias("links")).filter("false")
        roots = links.select(F.col("class_id").alias("node"), F.col("links").alias("root"))
    named = classes.join(links, "class_id", "left").join(roots, F.col("class_id") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "class_id"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    answers = named.join(least, "root").select(
        "label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"
    )
    found = good.select("vec_id", "label", "k1", "k2").join(answers, ["label", "k1", "k2"]).select(
        "vec_id", "n_links", F.col("component").alias("component_id")
    )
    alone = vectors.filter(~can_link()).select("vec_id", F.lit(0).cast("bigint"), F.col("vec_id").alias("component_id"))
    return found.union(alone).select(
        "vec_id",
        "n_links",
        F.col("component_id").cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
