"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Shallow trees are boosted cyclically, one feature
after the other; every tree only adds to its feature's lookup table, so what is
learned is one table per feature and one per chosen pair of features. A score is
the intercept plus one looked-up number per table, in whole-batch array additions.

Features are counted once over every whole text. Labels of at most
``SAMPLE_ROWS`` documents (chosen by a hash of the id) fit the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm.common import boxed, text_bytes, unboxed, values

SAMPLE_ROWS = 20_000  # labelled rows that fit the model, about
ROWS_AT_ONCE = 1000
FEATURES = [
    "log_bytes",
    "word_bytes",
    "distinct_words",
    "repeated_next",
    "upper",
    "lower",
    "digits",
    "stops",
    "symbols",
    "wide",
    "lines",
    "marked_ends",
    "bars",
]
_BYTE_CLASSES = {  # which byte values each share counts
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "stops": b".,;:?'\"()-",
    "symbols": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "lines": b"\n",
    "bars": b"|",
}


def _class_table() -> np.ndarray:
    shares = np.zeros((len(_BYTE_CLASSES) + 1, 256))
    for row, members in enumerate(_BYTE_CLASSES.values()):
        shares[row, list(members)] = 1
    shares[-1, 128:] = 1
    return shares


def text_features(text: bytes, classes: np.ndarray = _class_table()) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    size = len(text)
    if size == 0:
        return [0.0] * len(FEATURES)
    shares = dict(
        zip([*_BYTE_CLASSES, "wide"], classes @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size)
    )
    words = text.split()
    n = max(1, len(words))
    shares |= {
        "log_bytes": float(np.log(size)),
        "word_bytes": size / n,
        "distinct_words": len(set(words)) / n,
        "repeated_next": sum(map(bytes.__eq__, words, words[1:])) / n,
        "marked_ends": sum(not w[-1:].isalnum() for w in words) / n,
    }
    return [float(shares[name]) for name in FEATURES]


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and an array of features, one pass over the texts."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t) for t in values(batch, "_text")]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    return rows.mapInArrow(step, f"{kinds}, features array<double>")


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``pairs`` name the interacting features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]
    intercept: float

    def margin(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, features[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            left = np.searchsorted(self.pair_edges[a], features[:, a], side="right")
            right = np.searchsorted(self.pair_edges[b], features[:, b], side="right")
            total += table[left, right]
        return total

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow regression tree over ordered bins, as one value per bin."""
    whole_g, whole_w = gradient.sum(), weight.sum()
    leaf = np.full(len(gradient), whole_g / (whole_w + ridge))
    if depth == 0 or len(gradient) < 2:
        return leaf
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gain = g**2 / (w + ridge) + (whole_g - g) ** 2 / (whole_w - w + ridge)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= whole_g**2 / (whole_w + ridge) + 1e-12:
        return leaf
    return np.concatenate(
        [_tree(gradient[:cut], weight[:cut], depth - 1, ridge), _tree(gradient[cut:], weight[cut:], depth - 1, ridge)]
    )


def _quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best single cut on both axes of a pair: a value per cell, and its gain."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def corner(m: np.ndarray) -> tuple[np.ndarray, ...]:
        a, row, col, whole = m[:-1, :-1], m[:-1, -1:], m[-1:, :-1], m[-1, -1]
        return a, row - a, col - a, whole - row - col + a

    gains = sum(x**2 / (y + ridge) for x, y in zip(corner(g), corner(w)))
    if gains.size == 0:
        return np.zeros_like(gradient), 0.0
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty_like(gradient)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            out[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + ridge)
    return out, float(gains[i, j])


def fit(
    features: np.ndarray,
    labels: np.ndarray,
    rounds: int = 150,
    rate: float = 0.15,
    bins: int = 32,
    pair_bins: int = 8,
    n_pairs: int = 6,
    depth: int = 2,
    ridge: float = 5.0,
) -> AdditiveModel:
    """Cyclic boosting on at most ``SAMPLE_ROWS`` rows or so.

    Without labels the score is 0.5; with a single class it is that class's
    smoothed share.
    """
    n, width = len(labels), len(FEATURES)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    intercept = float(np.log(share / (1 - share)))
    empty = AdditiveModel([np.array([])] * width, [np.zeros(1)] * width, [], [], [], intercept)
    if n == 0 or labels.min() == labels.max():
        return empty
    edges = [_edges(features[:, j], bins) for j in range(width)]
    coarse = [_edges(features[:, j], pair_bins) for j in range(width)]
    at = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(edges)]
    at2 = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _tree(
                np.bincount(at[j], g, minlength=size), np.bincount(at[j], h, minlength=size), depth, ridge
            )
            tables[j] += step
            margin += step[at[j]]

    def cell_sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = at2[a] * shape[1] + at2[b]
        g, h = slopes()
        return tuple(np.bincount(cell, v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = {(a, b): _quadrants(*cell_sums(a, b), ridge)[1] for a in range(width) for b in range(a + 1, width)}
    pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:n_pairs]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(pairs):
            step = rate * _quadrants(*cell_sums(a, b), ridge)[0]
            pair_tables[k] += step
            margin += step[at2[a], at2[b]]
    return AdditiveModel(edges, tables, pairs, coarse, pair_tables, intercept)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per document: the majority of its rows, 1 at a tie."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("_label"))


def train(docs: DataFrame, labels: DataFrame, column: str, learn_from: Column, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on documents that are labelled and meet ``learn_from``, about ``rows`` of
    them: that bounds what is broadcast to find them and what reaches the driver."""
    pool = labelled(labels, column).filter(learn_from)
    share = min(1.0, rows / max(1, pool.count()))
    chosen = pool.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_features(sample, ["_label"]).toArrow()
    matrix = np.array(got.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    target = np.array(got.column("_label").to_pylist(), dtype=float)
    order = np.lexsort([target, *matrix.T])  # the same model whatever order the rows came in
    return fit(matrix[order], target[order])


def _score_batches(
    rows: DataFrame, keep: list[str], text: Callable[[pa.RecordBatch], list[bytes]], model: AdditiveModel, least: float | None
) -> DataFrame:
    """``keep`` columns and ``score``, the chance of label 1; only rows of ``least`` or more if given."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                matrix = np.array([text_features(t) for t in text(batch)], dtype=float)
                scores = model.score(matrix.reshape(-1, len(FEATURES)))
                columns = [batch.column(i) for i in range(len(keep))]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*keep, "score"])
                yield out if least is None else out.filter(pa.array(scores >= least))

    return rows.mapInArrow(step, f"{kinds}, score double")


def quality(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id`` and ``score`` per document.

    ``learn_from`` is a condition on ``doc_id`` for the labels that may be used.
    Null texts count as empty; repeated rows each get their score; a null id is
    never learned from. Columns other than ``doc_id`` and ``text`` are not read.
    """
    model = train(docs, labels, "quality", learn_from, rows)
    texts = docs.select("doc_id", text_bytes().alias("_text"))
    return _score_batches(texts, ["doc_id"], lambda batch: values(batch, "_text"), model, None)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored ``threshold`` or more, with their own columns, whatever
    these are called."""
    model = train(docs, labels, "quality", F.lit(True))

    def texts(batch: pa.RecordBatch) -> list[bytes]:
        return [t or b"" for t in batch.column(0).field("text").cast(pa.binary()).to_pylist()]

    return unboxed(_score_batches(boxed(docs).select("doc"), ["doc"], texts, model, threshold))
