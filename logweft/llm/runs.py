"""Periodic runs of words, from longest common extensions in suffix trees.

A run is a stretch of words with a period that no neighbouring word extends. Every run
holds a Lyndon root of its period that begins at some word, under the order of the words
or under its reverse, and that root ends where the next smaller (or next greater) suffix
begins. So two candidates a word are enough: each is extended to the right by the longest
common extension of two suffixes and to the left by that of two prefixes. Both come from
Ukkonen's suffix trees, one of the words and one of the reversed words: the extension is
the depth of the lowest common ancestor of two leaves, found in constant time as a range
minimum over the Euler tour. The tour keeps one entry for each step between two leaves,
the shallowest node on it, as only leaves are asked for.

Trees are built over the *regions* that can hold a run. A run that is long enough repeats
each of its grams of ``gram_length`` words at the distance of its period, so it lies in a
stretch of grams that all occur again in the same stretch. Regions are what is left when
this no longer changes anything; they hold all runs whole. A tree takes some 0.5 KB a word
of the longest region while it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweft.llm.common import text_bytes, values

LEAST_LENGTH = 24  # words of a run
LEAST_TIMES = 3  # periods in a run
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Ukkonen's tree of a list of numbers above 0; 0 ends it.

    ``suffixes`` are the leaves in the order of the tour, ``rank`` its inverse, ``gaps``
    the depth at which the tour turns between a leaf and the one before it.
    """

    def __init__(self, numbers: list[int]):
        text = [*numbers, 0]
        self._size, self._base = len(text), max(text) + 1
        starts, ends, edges = self._grown(text)
        self._toured(starts, ends, edges)
        self._tables = [self.gaps]
        while len(self._tables[-1]) > 1 << (len(self._tables) - 1):
            last, half = self._tables[-1], 1 << (len(self._tables) - 1)
            self._tables.append(np.minimum(last[:-half], last[half:]))

    def _grown(self, text: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
        size, base = self._size, self._base
        starts, ends, links = [0], [0], [0]  # of the edge that leads to a node; suffix links
        edges: dict[int, int] = {}  # node and first number to the node below
        node = edge = length = remaining = 0
        for i, number in enumerate(text):
            fresh = 0  # an inner node that waits for its suffix link
            remaining += 1
            while remaining:
                if length == 0:
                    edge = i
                key = node * base + text[edge]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(starts)
                    starts.append(i)
                    ends.append(size)
                    links.append(0)
                    if fresh:
                        links[fresh], fresh = node, 0
                else:
                    begin = starts[below]
                    span = ends[below] - begin
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    if text[begin + length] == number:
                        length += 1
                        if fresh:
                            links[fresh] = node
                        break
                    inner = len(starts)
                    starts += (begin, i)
                    ends += (begin + length, size)
                    links += (0, 0)
                    edges[key] = inner
                    edges[inner * base + number] = inner + 1
                    starts[below] = begin + length
                    edges[inner * base + text[begin + length]] = below
                    if fresh:
                        links[fresh] = inner
                    fresh = inner
                remaining -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = i - remaining + 1
        return starts, ends, edges

    def _toured(self, starts: list[int], ends: list[int], edges: dict[int, int]) -> None:
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        below = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        first = np.searchsorted(keys[order] // self._base, np.arange(len(starts) + 1)).tolist()
        depths, leaves, gaps = [0] * len(starts), [], []
        turn, at_leaf, waiting = 0, False, [0]
        while waiting:
            node = waiting.pop()
            depth = depths[node]
            if at_leaf:
                turn = depth - ends[node] + starts[node]
            a, b = first[node], first[node + 1]
            at_leaf = a == b
            if at_leaf:
                leaves.append(self._size - depth)
                gaps.append(turn)
            else:
                children = below[a:b]
                for child in children:
                    depths[child] = depth + ends[child] - starts[child]
                waiting += children[::-1]
        self.suffixes = np.array(leaves, np.int64)
        self.rank = np.empty(self._size, np.int64)
        self.rank[self.suffixes] = np.arange(self._size)
        self.gaps = np.array(gaps, np.int32)

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common beginnings of suffixes ``a`` and ``b``, pairwise different."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            of = level == k
            table = self._tables[k]
            out[of] = np.minimum(table[low[of]], table[high[of] + 1 - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller value, else the length."""
    out, waiting = [len(rank)] * len(rank), []
    for i, value in enumerate(rank):
        while waiting and rank[waiting[-1]] > value:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def tree_runs(numbers: list[int], least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> np.ndarray:
    """Runs (start, length, period) of numbers above 0, of ``times`` >= 2 periods and ``least`` numbers."""
    size = len(numbers)
    ahead = SuffixTree(numbers)
    rank = ahead.rank[:size].tolist()
    smaller = np.array(_next_smaller(rank), np.int64)
    greater = np.array(_next_smaller([-r for r in rank]), np.int64)
    at = np.arange(size)
    begins = np.concatenate([at, at[greater < size]])
    ends = np.concatenate([smaller, greater[greater < size]])
    right = ahead.extensions(begins, ends)  # the empty suffix at ``size`` has a leaf too
    del ahead
    left = np.zeros(len(begins), np.int64)
    inner = begins > 0
    left[inner] = SuffixTree(numbers[::-1]).extensions(size - begins[inner], size - ends[inner])
    period, start = ends - begins, begins - left
    length = ends + right - start
    long = length >= np.maximum(least, times * period)
    return np.unique(np.stack([start, length, period], 1)[long], axis=0)


def gram_length(least: int, times: int) -> int:
    """The most words of a gram of which each occurrence in a run is met again in it, a period away."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def regions(hashes: np.ndarray, least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> list[tuple[int, int]]:
    """Stretches (begin, end) of words that hold all runs, from equal hashes of equal words."""
    gram = gram_length(least, times)
    count = len(hashes) - gram + 1
    if len(hashes) < least:
        return []
    with np.errstate(over="ignore"):
        grams = np.zeros(count, np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
            grams ^= grams >> np.uint64(29)
        places, stretch = np.arange(count), np.zeros(count, np.uint64)
        while len(places):
            mixed = (grams[places] ^ stretch * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
            kept = places[_repeated(mixed)]
            cuts = np.flatnonzero(np.diff(kept) > 1) + 1
            begins = np.concatenate([[0], cuts]).astype(np.int64)
            sizes = np.diff(np.concatenate([begins, [len(kept)]]))
            long = np.repeat(sizes >= least - gram + 1, sizes)
            after = kept[long]
            sizes = sizes[sizes >= least - gram + 1]
            if len(after) == len(places):
                ends = np.cumsum(sizes)
                return [(int(after[e - s]), int(after[e - 1]) + gram) for s, e in zip(sizes, ends)]
            places, stretch = after, np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    return []


def word_runs(words: list[bytes], least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> np.ndarray:
    """All runs (start, length, period) of a document's words, by start and period."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = [np.empty((0, 3), np.int64)]
    for begin, end in regions(hashes, least, times):
        numbers: dict[bytes, int] = {}
        part = tree_runs([numbers.setdefault(w, len(numbers) + 1) for w in words[begin:end]], least, times)
        part[:, 0] += begin
        found.append(part)
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Whether a word stays: in no run, or among the first period's words of each run that holds it."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST_LENGTH,
    times: int = LEAST_TIMES,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``runs`` (start, length, period, by start and
    period) and ``collapsed``, the text with each run cut down to its first period.

    Words are what white space (ASCII) parts; ``collapsed`` joins them by one space.
    ``edit`` may change a document's words, given its id, before runs are looked for.
    Every row is worked on alone, so repeated rows and ids give equal rows. A null text
    and one without words have no runs and an empty ``collapsed``. Only ``doc_id`` (of
    any type, null allowed) and ``text`` are read; other columns can have any name.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets, flat, texts = [], [0], [], []
            for doc_id, text in zip(values(batch, "doc_id"), values(batch, "text")):
                words = text.split()
                if edit is not None:
                    words = edit(doc_id, words)
                runs = word_runs(words, least, times)
                if len(runs):
                    stays = kept_words(len(words), runs).tolist()
                    texts.append(b" ".join(w for w, k in zip(words, stays) if k))
                else:
                    texts.append(b" ".join(words))
                counts.append(len(words))
                flat.append(runs)
                offsets.append(offsets[-1] + len(runs))
            table = np.concatenate([np.empty((0, 3), np.int64), *flat])
            structs = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(table[:, i])) for i in range(3)], ["start", "length", "period"]
            )
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select("doc_id", text_bytes().alias("text"))
    found = rows.mapInArrow(step, f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: their number, the one with most periods (exact comparison;
    ties: least start, then least period; nulls without a run) and two digests."""

    def better(best, run):
        more, as_many = run["length"] * best["period"], best["length"] * run["period"]
        earlier = F.struct(run["start"], run["period"]) < F.struct(best["start"], best["period"])
        return F.when((more > as_many) | ((more == as_many) & earlier), run).otherwise(best)

    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
