"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes with the symbols that follow
them. A symbol seen in the longest known context has its share there, less half a
count; otherwise the context's escape, which these halves make up, is paid and the next
shorter context is asked, without the symbols that the longer one knew (exclusion);
below the shortest, what is left of the 256 symbols is equally likely. Each document's
code length is the sum over its bytes and one end symbol.

The trie is counted over all training texts, exactly, and every node takes part in the
scores. A symbol in the longest context that holds a share of at least 1 / ``MOST_NODES``
of all counts is known to all tasks, with its chance. The other symbols of a text, rare
or never seen there, are asked for: they are dealt by a hash of their last ``NEAR`` context
bytes, and so are the stored counts, so that one task has all nodes of ``NEAR`` bytes of
context and more that an answer can need. Shorter contexts have at most 256 ** ``NEAR``
symbols at any size of corpus; all tasks know them. Asks and answers travel in packed
groups, as sums of each text.

The plain comparison, token shares, needs the count of every token of every document.
Tokens with a share of at least 1 / ``MOST_FREQUENT`` are known to all tasks; the others
are joined with the stored counts, which return packed by the task that asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm.common import keyed, text_bytes, values
from logweft.session import materialize

ORDER = 5  # bytes of the longest context
NEAR = 3  # bytes of the shortest contexts that are dealt to tasks
MOST_NODES = 1 << 20  # nodes of one order that all tasks know
MOST_FREQUENT = 1 << 17  # tokens known to all tasks
END = 0xFF  # ends a text and stands before it; never a byte of UTF-8
END_TOKEN = b""
DISCOUNT = 0.5  # of every count, for the escape
BLOCK_BYTES = 1 << 20  # text bytes that are worked on at once
FLUSH = 1_500_000  # distinct keys that a task holds
ASKS = 1 << 18  # symbols that are asked for together
ANSWERS = 1 << 19  # counts of tokens that a task packs together
BUCKET_NODES = 1 << 18  # stored symbols that a bucket aims at
GRAM, TOKEN = 0, 1


def token_hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 7)


def normal_form(text: bytes) -> list[bytes]:
    """The text's tokens without its end: words with A-Z lower-cased."""
    return text.lower().split()


def packed_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every byte and end, packed; symbols per text)."""
    pad = bytes([END]) * ORDER
    whole = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    n = len(whole) - ORDER
    grams = np.zeros(n, np.uint64)
    for i in range(ORDER + 1):
        grams <<= np.uint64(8)
        grams |= whole[i : i + n]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    # A text's last ORDER + 1 bytes reach into the next one's padding: leave those out.
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    wanted = np.ones(n + ORDER, bool)
    for i in range(ORDER):
        wanted[starts[1:] - ORDER + i] = False
    return grams[wanted[:n]], sizes


class _Tally:
    """Counts of keys, merged when they are many."""

    def __init__(self) -> None:
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self._keys.append(found)
        self._counts.append(counts)
        self.size += len(found)
        if self.size > FLUSH and len(self._keys) > 4:
            self._merge()

    def _merge(self) -> None:
        keys, counts = np.concatenate(self._keys), np.concatenate(self._counts)
        found, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts, minlength=len(found)).astype(np.int64)
        self._keys, self._counts, self.size = [found], [total], len(found)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        self._merge()
        out = self._keys[0], self._counts[0]
        self.__init__()
        return out


def blocks(batch: pa.RecordBatch, *names: str) -> Iterator[list[tuple]]:
    """Rows of a batch in blocks of bounded text size; ``names`` begins with the text's."""
    held, size = [], 0
    for row in zip(*(values(batch, name) for name in names)):
        held.append(row)
        size += len(row[0]) + ORDER
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(docs: DataFrame) -> DataFrame:
    """(kind, key, n): grams and tokens of whole texts, counted within each task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {GRAM: _Tally(), TOKEN: _Tally()}

        def out(kind: int) -> pa.RecordBatch:
            keys, counts = tallies[kind].taken()
            kinds = pa.array(np.full(len(keys), kind, np.int32))
            return pa.RecordBatch.from_arrays(
                [kinds, pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"]
            )

        end = token_hash(END_TOKEN)
        for batch in batches:
            for block in blocks(batch, "_text"):
                cut = [normal_form(t) for (t,) in block]
                tallies[GRAM].add(packed_grams([b" ".join(words) for words in cut])[0])
                hashed = [token_hash(w) for words in cut for w in words]
                tallies[TOKEN].add(np.array(hashed + [end] * len(cut), np.uint64))
                for kind, tally in tallies.items():
                    if tally.size > FLUSH:
                        yield out(kind)
        for kind in tallies:
            yield out(kind)

    return docs.select("_text").mapInArrow(step, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(
        F.sum("n").alias("n")
    )


class Index:
    """Places of 64-bit keys: two tables of slots, then a search among the rest."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.tables, left = [], np.arange(len(keys))
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slots = self._slots(keys[left], odd)
            place = np.full(1 << self.bits, -1, np.int32)
            place[slots] = left
            held = np.zeros(1 << self.bits, np.uint64)
            taken = place >= 0
            held[taken] = keys[place[taken]]
            self.tables.append((odd, held, place))
            left = left[place[slots] != left]
        order = np.argsort(keys[left])
        self.rest_keys, self.rest = keys[left][order], left[order].astype(np.int32)

    def _slots(self, keys: np.ndarray, odd: int) -> np.ndarray:
        return ((keys * np.uint64(odd)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 where it is unknown."""
        odd, held, place = self.tables[0]
        slots = self._slots(keys, odd)
        out = np.where(held[slots] == keys, place[slots], -1)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            odd, held, place = self.tables[1]
            some = keys[missing]
            slots = self._slots(some, odd)
            out[missing] = np.where(held[slots] == some, place[slots], -1)
            if len(self.rest):
                missing = missing[out[missing] < 0]
                at = np.minimum(np.searchsorted(self.rest_keys, keys[missing]), len(self.rest) - 1)
                out[missing] = np.where(self.rest_keys[at] == keys[missing], self.rest[at], -1)
        return out


@dataclass
class Order:
    """Nodes of one order: symbols in their contexts, and the contexts' sums.

    ``total`` counts all symbols of a context, kept or not, and ``sure`` the kept ones,
    less DISCOUNT each: what is between goes to the escape. ``beyond`` is what the next
    shorter context gives the symbols known here.
    """

    symbols: Index
    weight: np.ndarray
    contexts: Index
    total: np.ndarray
    sure: np.ndarray
    kinds: np.ndarray
    beyond: np.ndarray


class Trie:
    """The static model; ``nodes[d]`` has (keys of d + 1 bytes, counts, contexts of d
    bytes, their total counts)."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], below: tuple[Order, ...] = ()):
        self.orders: list[Order] = [*below]
        for d, (keys, counts, contexts, totals) in enumerate(nodes, len(below)):
            order = np.argsort(keys)
            keys, weight = keys[order], counts[order] - DISCOUNT
            own, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            sums = lambda v: np.bincount(at, v, minlength=len(own))
            place = np.argsort(contexts)
            total = totals[place][np.searchsorted(contexts[place], own)].astype(float)
            shorter = np.zeros(len(keys))
            if d:
                longer = self.orders[-1]
                shorter = longer.weight[longer.symbols.find(keys & self._mask(d))]
            self.orders.append(
                Order(Index(keys), weight, Index(own), total, sums(weight), sums(np.ones(len(keys))), sums(shorter))
            )

    def extended(self, grams: np.ndarray, counts: np.ndarray) -> Trie:
        """With the longer contexts of some counted symbols of ORDER bytes of context: all
        that share their last NEAR context bytes."""
        return Trie(nodes_of(grams, counts, range(len(self.orders), ORDER + 1)), tuple(self.orders))

    @staticmethod
    def _mask(n: int) -> np.uint64:
        return np.uint64((1 << 8 * n) - 1)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of every symbol's chance in its context of ORDER bytes."""
        out = np.zeros(len(grams))
        active = np.arange(len(grams))
        beyond, excluded = np.zeros(len(grams)), np.zeros(len(grams))
        for d in range(len(self.orders) - 1, -1, -1):
            order, keys = self.orders[d], grams[active] & self._mask(d + 1)
            context = order.contexts.find(keys >> np.uint64(8))
            known = np.flatnonzero(context >= 0)
            context, rows = context[known], active[known]
            symbol = order.symbols.find(keys[known])
            total = order.total[context] - beyond[rows]
            hit = symbol >= 0
            out[rows[hit]] += np.log10(order.weight[symbol[hit]] / total[hit])
            escape = total - (order.sure[context] - beyond[rows])
            out[rows[~hit]] += np.log10(escape[~hit] / total[~hit])
            if d:
                beyond[rows] = order.beyond[context]
            excluded[rows] = order.kinds[context]
            left = np.ones(len(active), bool)
            left[known[hit]] = False
            active = active[left]
        out[active] -= np.log10(256 - excluded[active])
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the chance of each normal-form text with its end."""
        grams, sizes = packed_grams(texts)
        return np.add.reduceat(self.log10(grams), np.cumsum(sizes) - sizes)


def kept_nodes(grams: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """For each order its frequent nodes, from (key, n) of the longest: at most MOST_NODES
    symbols each, with their contexts and what these count with all symbols, kept or not."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    nodes = []
    for d in range(ORDER, -1, -1):
        mask = F.lit((1 << 8 * (d + 1)) - 1)
        level = grams.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
        frequent = F.when(F.col("n") * MOST_NODES >= F.lit(total), F.struct("key", "n"))
        by_context = level.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.collect_list(frequent).alias("kept")
        )
        got = by_context.filter(F.size("kept") > 0).toArrow()
        kept = got.column("kept").combine_chunks().flatten() if len(got) else None
        column = lambda values, kind: np.asarray(values).astype(kind)
        nodes.append(
            (
                column(kept.field("key") if len(got) else [], np.uint64),
                column(kept.field("n") if len(got) else [], np.int64),
                column(got.column("context").to_numpy(), np.uint64),
                column(got.column("total").to_numpy(), np.int64),
            )
        )
    return nodes[::-1]


def nearest_nodes(grams: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """All nodes of contexts of fewer than NEAR bytes."""
    level = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * NEAR) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, counts = level.column("key").to_numpy().view(np.uint64), level.column("n").to_numpy()
    return nodes_of(keys, counts, range(NEAR))


def nodes_of(grams: np.ndarray, counts: np.ndarray, orders: range) -> list[tuple[np.ndarray, ...]]:
    nodes = []
    for d in orders:
        keys, at = np.unique(grams & Trie._mask(d + 1), return_inverse=True)
        n = np.bincount(at, counts, minlength=len(keys))
        contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        nodes.append((keys, n, contexts, np.bincount(at, n, minlength=len(contexts))))
    return nodes


def frequent_nodes(grams: DataFrame) -> tuple[np.ndarray, ...]:
    """Keys and counts of the frequent symbols in their longest contexts, these contexts and their totals."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    frequent = grams.filter(F.col("n") * MOST_NODES >= F.lit(total))
    context = F.shiftrightunsigned("key", 8).alias("context")
    wanted = F.broadcast(frequent.select(context).distinct())
    sums = grams.select(context, "n").join(wanted, "context", "left_semi").groupBy("context").agg(F.sum("n").alias("n")).toArrow()
    got = frequent.toArrow()
    return (
        got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy(),
        sums.column("context").to_numpy().view(np.uint64), sums.column("n").to_numpy(),
    )


class Frequent:
    """Frequent symbols of the longest contexts: log10 of their chances."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray):
        place = np.argsort(contexts)
        total = totals[place][np.searchsorted(contexts[place], keys >> np.uint64(8))]
        self.log = np.log10((counts - DISCOUNT) / total)
        self.index = Index(keys)

    def score(self, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of texts over their frequent symbols; the other symbols and their texts."""
        at = self.index.find(grams)
        known = at >= 0
        logs = np.zeros(len(grams))
        logs[known] = self.log[at[known]]
        whose = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(whose, logs, minlength=len(sizes)), grams[~known], whose[~known]


_ODD, _SHIFT = 2654435761, 20  # of a hash


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    near = (grams >> np.uint64(8)) & np.uint64((1 << 8 * NEAR) - 1)
    return (((near * np.uint64(_ODD)) >> np.uint64(_SHIFT)) % np.uint64(buckets)).astype(np.int32)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of the numbers, all first bytes before all second ones."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _of_planes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.view("<u8").ravel()


def _packed(grams: np.ndarray, numbers: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, its grams and their numbers of at most 6 bytes), sorted so that they shrink."""
    bucket = _bucket(grams, buckets)
    order = np.lexsort([grams, bucket])
    grams, numbers, bucket = grams[order], numbers[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    out = []
    for a, b in zip(starts, [*starts[1:], len(bucket)]):
        data = _planes(numbers[a:b], 6) + _planes(grams[a:b], ORDER + 1)
        out.append((int(bucket[a]), (b - a).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)))
    return out


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], n * (6 + ORDER + 1), "zstd", asbytes=True), np.uint8)
    return _of_planes(raw[6 * n :], ORDER + 1), _of_planes(raw[: 6 * n], 6)


class Asks:
    """Symbols of a task's texts that are not frequent, packed by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.group = buckets, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.texts = 0

    @property
    def home(self) -> int:
        """Where answers go: a number of the task and of its group of asks."""
        return (TaskContext.get().partitionId() << 32) + self.group

    def add(self, grams: np.ndarray, texts: np.ndarray, n_texts: int) -> None:
        self.held.append((grams, texts + self.texts))
        self.size, self.texts = self.size + len(grams), self.texts + n_texts

    def taken(self) -> list[tuple[int, int, bytes]]:
        """(home, bucket, asks) of what is held."""
        grams, texts = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        out = [(self.home, bucket, packed) for bucket, packed in _packed(grams, texts, self.buckets)]
        self.held, self.size, self.texts, self.group = [], 0, 0, self.group + 1
        return out


def packed_counts(grams: DataFrame, buckets: int) -> DataFrame:
    """(bucket, home, asks) with the counts of stored symbols in place of texts, and no home."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            of, packed = zip(*_packed(*(np.concatenate([h[i] for h in held]) for i in (0, 1)), buckets))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int32()), pa.nulls(len(of), pa.int64()), pa.array(packed, pa.binary())],
                names=["bucket", "home", "asks"],
            )

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
                size += len(batch)
            if size >= FLUSH:
                yield out()
                size = 0
        if held:
            yield out()

    return grams.mapInArrow(step, "bucket int, home bigint, asks binary")


def answered(asks: DataFrame, grams: DataFrame, short: Trie, buckets: int) -> DataFrame:
    """``home``, ``place`` and ``asked_score``: the sum over all that a text asked for.

    ``asks`` has home, bucket and asks; ``grams`` is (key, n) of all symbols in their
    longest contexts and ``short`` has all contexts of fewer than NEAR bytes.
    """
    shared = asks.sparkSession.sparkContext.broadcast(short)

    def answers(trie: Trie, homes: list[int], packed: list[bytes]) -> pa.RecordBatch:
        asked = [_unpacked(p) for p in packed]
        logs = trie.log10(np.concatenate([grams for grams, _ in asked]))
        out, start = [], 0
        for grams, own in asked:
            found, at = np.unique(own, return_inverse=True)
            out.append(_planes(found, 4) + np.bincount(at, logs[start : start + len(grams)]).tobytes())
            start += len(grams)
        return pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(out, pa.binary())], names=["home", "sums"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, counts, trie = None, [], [], None
        for batch in batches:
            of, asking = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(of) != 0) | (np.diff(asking.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
                if a == b:
                    continue
                if of[a] != bucket:
                    bucket, keys, counts, trie = of[a], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], None
                if not asking[a]:
                    for packed in batch.column(2).slice(a, b - a).to_pylist():
                        found, n = _unpacked(packed)
                        keys.append(found)
                        counts.append(n)
                    continue
                if trie is None:
                    trie = shared.value.extended(np.concatenate(keys), np.concatenate(counts))
                for at in range(a, b, 256):
                    some = [batch.column(i).slice(at, min(256, b - at)).to_pylist() for i in (1, 2)]
                    yield answers(trie, *some)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, total, seen = None, np.zeros(0), np.zeros(0, bool)

        def out() -> pa.RecordBatch:
            places = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(places), home)), pa.array(places), pa.array(total[places])],
                names=["home", "place", "asked_score"],
            )

        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != home:
                    if home is not None:
                        yield out()
                    home, total, seen = own, np.zeros(0), np.zeros(0, bool)
                n = len(packed) // 12
                raw = np.frombuffer(packed, np.uint8)
                places = _of_planes(raw[: 4 * n], 4).astype(np.int64)
                more = max(0, int(places.max()) + 1 - len(total))
                total, seen = np.pad(total, (0, more)), np.pad(seen, (0, more))
                total[places] += raw[4 * n :].copy().view(np.float64)
                seen[places] = True
        if home is not None:
            yield out()

    both = packed_counts(grams, buckets).union(asks.select("bucket", "home", "asks"))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.col("home").asc_nulls_first())
    found = dealt.mapInArrow(look_up, "home bigint, sums binary").repartition("home").sortWithinPartitions("home")
    return found.mapInArrow(add_up, "home bigint, place bigint, asked_score double")


def _packed_answers(home: np.ndarray, place: np.ndarray, n: np.ndarray) -> list[tuple[int, bytes]]:
    """(task that asked, its texts' places and counts): a row for each task instead of each token."""
    order = np.lexsort([n, place, home])
    home, place, n = home[order], place[order], n[order]
    task, at = home >> 32, ((home & 0xFFFFFFFF) << 32) + place
    starts = np.flatnonzero(np.diff(task, prepend=-1)).tolist()
    out = []
    for a, b in zip(starts, [*starts[1:], len(task)]):
        data = _planes(np.diff(at[a:b], prepend=0), 8) + _planes(n[a:b], 6)
        out.append((int(task[a]), (b - a).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)))
    return out


def _unpacked_answers(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], n * (8 + 6), "zstd", asbytes=True), np.uint8)
    return np.cumsum(_of_planes(raw[: 8 * n], 8).view(np.int64)), _of_planes(raw[8 * n :], 6).view(np.int64)


def token_sums(counts: DataFrame, share: float) -> DataFrame:
    """``home``, ``place``, ``rare_score`` and ``rare_known`` of every text, from (home, place, n)
    of its tokens: the sum of their shares' logarithms, and how many are known."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            tasks, packed = zip(*_packed_answers(*(np.concatenate([h[i] for h in held]) for i in range(3))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array(packed, pa.binary())], names=["task", "counts"])

        for batch in batches:
            if len(batch):
                held.append([batch.column(i).to_numpy() for i in range(3)])
                size += len(batch)
            if size >= ANSWERS:
                yield out()
                size = 0
        if held:
            yield out()

    def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, scores, known = (np.concatenate([p[i] for p in parts]) for i in range(3))
        found, own = np.unique(at, return_inverse=True)
        return found, np.bincount(own, scores), np.bincount(own, known)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts = None, []

        def out() -> pa.RecordBatch:
            at, scores, known = summed(parts)
            columns = [(task << 32) + (at >> 32), at & 0xFFFFFFFF, scores, known.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["home", "place", "rare_score", "rare_known"])

        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != task:
                    if parts:
                        yield out()
                    task, parts = own, []
                at, n = _unpacked_answers(packed)
                parts.append(summed([(at, np.log10(n + 0.5) - share, n > 0)]))
                if len(parts) == 64:
                    parts = [summed(parts)]
        if parts:
            yield out()

    answers = counts.select("home", "place", "n").mapInArrow(pack, "task bigint, counts binary")
    dealt = answers.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(add_up, "home bigint, place bigint, rare_score double, rare_known bigint")


def scored(docs: DataFrame, learn_from: Column, held_out: Column) -> DataFrame:
    """Scores of every whole text under the model and under plain token shares.

    ``learn_from`` and ``held_out`` are conditions on ``doc_id``; a null one is false.
    Null texts are empty: they have the end token alone. Repeated rows are documents of
    their own. Without training texts the trie has no nodes, so all bytes are equally
    likely. Other columns are not read.
    """
    rows = keyed(docs, ["doc_id", "text"]).select(
        "row_key", "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes().alias("_text"),
        F.coalesce(learn_from, F.lit(False)).alias("_learn"),
    )
    counts = materialize(counted(rows.filter("_learn")), "ppm-counts")
    tokens = counts.filter(F.col("kind") == TOKEN).select("key", "n")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n")
    nearest, short = Frequent(*frequent_nodes(grams)), Trie(nearest_nodes(grams))
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), grams.count() // BUCKET_NODES)
    frequent = tokens.filter(F.col("n") * MOST_FREQUENT >= F.lit(n)).toArrow()
    known = {int(k): c for k, c in zip(frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_pylist())}
    share = np.log10(n + 0.5 * (v + 1))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((nearest, {k: float(np.log10(c + 0.5) - share) for k, c in known.items()}))
    end_key = int(np.array([token_hash(END_TOKEN)], np.uint64).view(np.int64)[0])
    end_row = tokens.filter(F.col("key") == end_key).first()
    end_score, end_known = float(np.log10((end_row["n"] if end_row else 0) + 0.5) - share), int(end_row is not None)

    kind = dict(docs.dtypes)["doc_id"]
    fields = (
        f"row_key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double,"
        " score double, rare array<bigint>, place bigint, home bigint, bucket int, asks binary"
    )
    names = ["row_key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "place", "home", "bucket", "asks"]

    together = ASKS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, shares = shared.value
        asks, id_type = Asks(buckets), None

        def asked() -> pa.RecordBatch:
            homes, of, packed = zip(*taken) if (taken := asks.taken()) else ([], [], [])
            types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.int64()]
            empty = [pa.nulls(len(homes), t) for t in types]
            own = [pa.array(homes, pa.int64()), pa.array(of, pa.int32()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, *own], names=names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for block in blocks(batch, "_text", "row_key", "doc_id", "held_out"):
                cut = [normal_form(row[0]) for row in block]
                scores, unknown, texts = nearest.score(*packed_grams([b" ".join(words) for words in cut]))
                places, home = np.arange(len(block)) + asks.texts, asks.home
                asks.add(unknown, texts, len(block))
                base, found, rare = [], [], []
                for words in cut:
                    hashed = list(map(token_hash, words))
                    weights = [shares.get(h) for h in hashed]
                    seen = [w for w in weights if w is not None]
                    base.append(sum(seen) + end_score)
                    found.append(len(seen) + end_known)
                    rare.append([h for h, w in zip(hashed, weights) if w is None] if len(seen) < len(hashed) else [])
                flat = np.array([h for some in rare for h in some], np.uint64).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(some) for some in rare])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row[1] for row in block], pa.int64()),
                        pa.array([row[2] for row in block], id_type),
                        pa.array([row[3] for row in block], pa.bool_()),
                        pa.array([len(words) + 1 for words in cut], pa.int64()),
                        pa.array(found, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(scores, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(places, pa.int64()),
                        pa.array(np.full(len(block), home), pa.int64()),
                        pa.nulls(len(block), pa.int32()),
                        pa.nulls(len(block), pa.binary()),
                    ],
                    names=names,
                )
                if asks.size >= together:
                    yield asked()
        if asks.held:
            yield asked()

    stored = materialize(rows.drop("_learn").mapInArrow(step, fields), "ppm-scores")
    answers = answered(stored.filter("bucket IS NOT NULL"), grams, short, buckets)
    measured = stored.filter("bucket IS NULL").drop("bucket", "asks")
    missing = measured.select("home", "place", F.explode("rare").alias("key")).join(tokens, "key", "left")
    rest = token_sums(missing.select("home", "place", F.coalesce("n", F.lit(0)).alias("n")), float(share))
    return measured.drop("rare").join(rest, ["home", "place"], "left").join(answers, ["home", "place"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("asked_score", F.lit(0.0))).alias("score"),
    )
