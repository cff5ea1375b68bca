"""Substring dedup with prefix-partitioned suffix trees.

A window is ``WINDOW`` words. Of all suffixes only those that begin at *anchors* are
put into trees: an anchor is the first word of the least ``PREFIX``-word hash of some
window (the last of equals), so two equal windows hold the same anchor at the same
place, and a suffix tree of anchors finds every repeat that a tree of all suffixes
would. The steps:

1. Anchors are counted by prefix. A prefix that begins one suffix only roots no
   branch and is dropped: its windows are unique.
2. Suffixes with a shared prefix are dealt to trees by that prefix. A tree must fit
   memory: where a prefix begins more than ``TREE`` suffixes it is made longer, up to
   the whole window, whose node needs no tree: a count of its leaves is enough. Equal
   surroundings of an anchor are counted as one before that, first within a batch, where
   all but one of them are told to be repeats at once and are not shuffled.
3. In a tree, the suffixes of windows are ordered; neighbours that agree in all
   ``WINDOW`` words lie below one deep internal node. Such nodes with two leaves or
   more are the repeats, and runs of them in a document are its maximal repeats.

Words and paths are compared by 64-bit hashes; a window is told apart by its prefix's
hash and its own, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logweft.llm.common import boxed, keyed, text_bytes, unboxed, values
from logweft.session import materialize

WINDOW = 35  # words of a repeat, at least
PREFIX = 8  # words that a tree's suffixes share
TREE = 1000  # suffixes of one tree; prefixes with more are made longer
BLOCK_WORDS = 1 << 18  # words of a text that are hashed at once
FLUSH = 200_000  # anchors per output batch
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & _WRAP, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(BLOCK_WORDS + 1, _ODD)
_DOWN = _powers(BLOCK_WORDS + 1, pow(_ODD, -1, 1 << 64))


def _path_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, from running sums."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _UP[:n], out=sums[1:])
    found = (sums[size:] - sums[:-size]) * _DOWN[: n - size + 1]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def _least_last(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` values in a row, the place of the least, the last of equals.
    Values are compared by their upper 44 bits."""
    n = len(hashes)
    low = np.uint64((1 << 20) - 1)
    packed = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    size = 1
    best = packed
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: n - width + 1], best[width - size : n - size + 1])
    return (low - (best & low)).astype(np.int64)


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first window, prefix hash at its anchor, anchor's place, window hash)
    for every window of a text."""
    hashed, n = xxhash.xxh64_intdigest, len(words)
    step = BLOCK_WORDS - window
    for start in range(0, n - window + 1, step):
        part = words[start : start + step + window - 1]
        ids = np.fromiter(map(hashed, part), np.uint64, len(part))
        prefixes = _path_hashes(ids, PREFIX)
        at = _least_last(prefixes, window - PREFIX + 1)
        yield start, prefixes[at], at + start, _path_hashes(ids, window)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, row_key, place) of all anchors."""
    held: list[tuple[np.ndarray, int, np.ndarray]] = []

    def flushed() -> pa.RecordBatch:
        sizes = [len(h[0]) for h in held]
        columns = [
            pa.array(np.concatenate([h[0] for h in held]).view(np.int64)),
            pa.array(np.repeat([h[1] for h in held], sizes)),
            pa.array(np.concatenate([h[2] for h in held]).astype(np.int32)),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["prefix", "row_key", "place"])

    for batch in batches:
        size = 0
        for key, text in zip(values(batch, "row_key"), values(batch, "_text")):
            last = -1
            for _, prefixes, places, _ in windows_of(text.split()):
                # Anchors never go back, so a change of place is a new anchor.
                new = np.flatnonzero(np.diff(places, prepend=last))
                held.append((prefixes[new], key, places[new]))
                last = places[-1]
                size += len(new)
            if size >= FLUSH:
                yield flushed()
                size = 0
        if held:
            yield flushed()


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every shared anchor a row with the hashes of its windows (the suffixes below
    its prefix): the first window's start, the words from there to the anchor, the hashes.

    Of anchors with long prefixes and equal windows in a batch the first stands for ``n``;
    the words of all of them are repeats: rows with an ``end`` and nothing else."""
    for batch in batches:
        keys, starts, leads, prefixes_of, longs, paths = [], [], [], [], [], []
        ns, same = [], {}
        spans: list[list[int]] = []

        def repeated(key: int, start: int, size: int) -> None:
            end = start + size - 1 + WINDOW
            if spans and spans[-1][0] == key and spans[-1][1] <= start <= spans[-1][2]:
                spans[-1][2] = max(end, spans[-1][2])
            else:
                spans.append([key, start, end])

        for key, text, shared in zip(values(batch, "row_key"), values(batch, "_text"), values(batch, "shared")):
            wanted = {s["place"]: s["long"] for s in shared}
            for start, prefixes, places, hashes in windows_of(text.split()):
                edges = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1, [len(places)]])
                for a, b, place in zip(edges[:-1].tolist(), edges[1:].tolist(), places[edges[:-1]].tolist()):
                    long = wanted.get(place)
                    if long:
                        equal = prefixes[a], place - start - a, hashes[a:b].tobytes()
                        known = same.setdefault(equal, len(keys))
                        if known < len(keys):
                            if ns[known] == 1:
                                repeated(keys[known], starts[known], b - a)
                            ns[known] += 1
                            repeated(key, start + a, b - a)
                            continue
                    if long is not None:
                        ns.append(1)
                        keys.append(key)
                        starts.append(start + a)
                        leads.append(place - start - a)
                        prefixes_of.append(prefixes[a])
                        longs.append(long)
                        paths.append(hashes[a:b])
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.uint64), *paths]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(prefixes_of, np.uint64).view(np.int64)),
                pa.array(keys, pa.int64()),
                pa.array(starts, pa.int32()),
                pa.array(leads, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array(longs, pa.bool_()),
                pa.array(ns, pa.int64()),
                pa.nulls(len(keys), pa.int64()),
            ],
            names=_SUFFIX_NAMES,
        )
        if spans:
            none = [pa.nulls(len(spans), kind) for kind in (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int64())]
            key, start, end = (pa.array([s[i] for s in spans], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64())))
            yield pa.RecordBatch.from_arrays([none[0], key, start, *none[1:], end], names=_SUFFIX_NAMES)


def _repeats_of_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by prefix: (row_key, start, end) of words under repeated windows.
    A tree's rows follow each other and are few; an unfinished tree waits for more rows."""
    waiting: pa.Table | None = None

    def found(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        prefix = rows.column("prefix").to_numpy()
        keys, starts = rows.column("row_key").to_numpy(), rows.column("start").to_numpy()
        offsets = rows.column("lead").to_numpy()
        paths = rows.column("paths").combine_chunks()
        sizes = np.diff(paths.offsets.to_numpy())
        whose = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        path = paths.flatten().to_numpy()
        # Leaves in the order of the trees: by prefix, then by the rest of their window.
        lead = offsets[whose] - within  # words of the window before the anchor
        order = np.lexsort([lead, path, prefix[whose]])
        p, h, l = prefix[whose][order], path[order], lead[order]
        same = (p[1:] == p[:-1]) & (h[1:] == h[:-1]) & (l[1:] == l[:-1])
        deep = np.zeros(len(order), bool)
        deep[1:] |= same
        deep[:-1] |= same
        repeated = np.zeros(len(order), bool)
        repeated[order] = deep
        at = np.flatnonzero(repeated)
        # Windows one after the other in a row make one maximal repeat.
        first = np.ones(len(at), bool)
        first[1:] = (whose[at][1:] != whose[at][:-1]) | (within[at][1:] != within[at][:-1] + 1)
        a = at[first]
        b = at[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(at) - 1]])] if len(at) else a
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys[whose[a]]),
                pa.array((starts[whose[a]] + within[a]).astype(np.int64)),
                pa.array((starts[whose[b]] + within[b] + WINDOW).astype(np.int64)),
            ],
            names=["row_key", "start", "end"],
        )

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        prefix = rows.column("prefix").to_numpy()
        done = int(np.searchsorted(prefix, prefix[-1], side="left")) if len(prefix) else 0
        waiting = rows.slice(done).combine_chunks()
        if done:
            yield found(rows.slice(0, done))
    if waiting is not None and len(waiting):
        yield found(waiting)


_SUFFIX = "prefix bigint, row_key bigint, start int, lead int, paths array<bigint>, long boolean, n bigint, end bigint"
_SUFFIX_NAMES = ["prefix", "row_key", "start", "lead", "paths", "long", "n", "end"]


def _repeats_of_long_prefixes(suffixes: DataFrame) -> DataFrame:
    """(row_key, start, end) where a prefix is too frequent for a tree.

    Anchors with the same windows all around are one row with a count before anything
    else; with a count of two they are repeats. Rows that stand for several are told to be
    repeats already. The windows of the different ones are counted with the whole window
    as the prefix."""
    same = ["prefix", "lead", "around"]
    marked = suffixes.withColumn("around", F.xxhash64("paths"))
    distinct = materialize(
        marked.groupBy(*same, "paths").agg(
            F.sum("n").alias("n"), F.min("row_key").alias("row_key"), F.min("start").alias("start")
        ),
        "long-prefixes",
    )
    end = (F.col("start") + F.size("paths") - 1 + WINDOW).cast("bigint").alias("end")
    copied = marked.filter("n = 1").join(distinct.filter("n > 1").select(*same, "paths"), [*same, "paths"], "left_semi").select(
        "row_key", F.col("start").cast("bigint").alias("start"), end
    )
    leaves = distinct.select("prefix", "lead", "n", "row_key", "start", F.posexplode("paths").alias("at", "path"))
    leaves = leaves.withColumn("lead", F.col("lead") - F.col("at"))
    node = ["prefix", "lead", "path"]
    deep = leaves.groupBy(*node).agg(F.sum("n").alias("leaves")).filter("leaves > 1").select(*node)
    first = (F.col("start") + F.col("at")).cast("bigint")
    single = leaves.filter("n = 1").join(deep, node).select(
        "row_key", first.alias("start"), (first + WINDOW).alias("end")
    )
    return copied.union(single)


def repeats(rows: DataFrame) -> DataFrame:
    """(row_key, start, end): words of maximal repeats, a row per tree they were found in.
    ``rows`` has row_key and _text."""
    anchors = materialize(rows.mapInArrow(_anchors, "prefix bigint, row_key bigint, place int"), "anchors")
    branches = materialize(anchors.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1"), "branches")
    shared = anchors.join(branches, "prefix").select(
        "row_key", F.struct("place", (F.col("n") > TREE).alias("long")).alias("shared")
    )
    by_document = shared.groupBy("row_key").agg(F.collect_list("shared").alias("shared"))
    cut = rows.join(by_document, "row_key").select("row_key", "_text", "shared")
    suffixes = materialize(cut.mapInArrow(_suffixes, _SUFFIX), "suffixes")
    short = suffixes.filter("NOT long").drop("long", "n", "end").repartition("prefix").sortWithinPartitions("prefix")
    in_trees = short.mapInArrow(_repeats_of_trees, "row_key bigint, start bigint, end bigint")
    told = suffixes.filter("end IS NOT NULL").select("row_key", F.col("start").cast("bigint").alias("start"), "end")
    return in_trees.union(_repeats_of_long_prefixes(suffixes.filter("long").drop("long", "end"))).union(told)


def _stays(n_words: int, spans: list[dict] | None) -> np.ndarray:
    """Which words of a document are under none of the spans."""
    change = np.zeros(n_words + 1, np.int32)
    if spans:
        edges = np.array([(s["start"], s["end"]) for s in spans])
        np.add.at(change, edges[:, 0], 1)
        np.add.at(change, edges[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _spanned(rows: DataFrame) -> DataFrame:
    spans = repeats(rows.select("row_key", "_text")).groupBy("row_key")
    listed = spans.agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows.join(listed, "row_key", "left")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, its words, those removed, and the kept words' digest.

    Every copy of a repeat goes, the first as well, whether it is in another document
    or the same. Null or empty texts have no words; texts of fewer than ``WINDOW`` words
    stay whole; repeated rows are documents of their own; other columns are not read.
    """
    rows = keyed(docs, ["doc_id", "text"]).select("row_key", "doc_id", text_bytes().alias("_text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, digests = [], [], []
            for text, spans in zip(values(batch, "_text"), values(batch, "spans")):
                words = text.split()
                stay = _stays(len(words), spans)
                counts.append(len(words))
                gone.append(len(words) - int(stay.sum()))
                kept = compress(words, stay.tolist()) if gone[-1] else words
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _spanned(rows).select("doc_id", "_text", "spans").mapInArrow(
        step, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their own columns and without repeated words: a text that
    loses none is unchanged, else its kept words are joined by one space. Documents
    that lose every word stay, with an empty text; a null text stays null."""
    rows = keyed(boxed(docs), ["doc", "doc_id", "text"]).select("row_key", "doc", text_bytes().alias("_text"))
    fields = rows.schema["doc"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, spans in zip(values(batch, "_text"), values(batch, "spans")):
                words = text.split()
                stay = _stays(len(words), spans)
                left.append(None if stay.all() else b" ".join(compress(words, stay.tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["doc", "left"])

    cut = _spanned(rows).select("doc", "_text", "spans").mapInArrow(step, f"doc {fields}, left string")
    return unboxed(cut, F.coalesce("left", "doc.text"))
