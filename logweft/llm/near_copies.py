"""Near copies by word shingles: ball hashing of wide SimHash, then real similarity.

Documents are alike when the sets of their five-word shingles have a Jaccard similarity
of 0.8 or more. Fingerprints of such pairs differ in some 15 of 100 bits, far more than
whole balls can reach, so balls are taken in parts of a fingerprint:

1. A fingerprint has 256 bits over the distinct shingles. Bits of a tie come from a
   digest of the whole set, so that small sets that share a part stay apart.
2. Parts of ``width`` bits are drawn from it. In each part a fingerprint emits all
   variants within half the radius (one of two bits), and meets those that emit the
   same. A part has at least as many bits as the number of fingerprints, so what meets by
   chance stays a few per fingerprint at any size; there are as many parts as it takes
   for a pair of similarity 0.8 to meet with a chance of ``FOUND``.
3. Those that meet are compared by their first 128 bits and by the sizes of their sets. Each one
   names the nearest before and after it. In groups above ``GROUP`` it names the nearest
   *leader*: one is a leader when no earlier leader is near. Crowded variants are thinned
   to leaders before the shuffle as well, so a hot group is never gathered.
4. Named pairs are verified on the shingles themselves, and verified ones are joined up.
5. What was not named is not lost: the rows of near pairs without a name, and all rows of
   crowded variants, thinned ones included, are kept aside as chains of names, a chain a variant;
   the same link of many variants counts once. All rows kept aside whose root is next to
   another one somewhere in a chain, and so all of a variant with several roots, are joined by
   their rarest shingles, as many as a pair of that similarity must share one of, and every
   pair found is verified as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from logweft.llm.common import boxed, keyed, text_bytes, unboxed, values
from logweft.llm.links import components
from logweft.session import materialize

SHINGLE = 5  # words
SIMILARITY = 0.8  # of the sets of shingles, at least
BITS = 256
CARRIED = 128  # bits that variants bring with them to be compared
FOUND = 0.95  # chance that a pair of just that similarity meets
APART = 30  # differing bits of those, of a pair that is verified, at most (a pair of 0.8 has 19 +- 4)
LEAST_WIDTH = 24  # bits of a part
GROUP = 64  # fingerprints of one variant that are all compared
LOCAL_GROUP = 16  # the same before the shuffle
BLOCK = 4096  # fingerprints that are worked on at once
CROWD = 4096  # rows of a shingle that are met by those of other roots at once
SIZE_BITS = 11
THINNED = (1 << SIZE_BITS) - 1  # in place of a size: rows of this variant were thinned (no set is as large)
NAMED, ASIDE = -1, -2  # keys of pairs to verify, and of links of chains kept aside
_SIZE_STEP = 32  # codes for each doubling of a set's size
_SIZES_APART = math.ceil(-math.log2(SIMILARITY) * _SIZE_STEP)  # rounding included
_PRINT = ["q0", "q1", "q2", "q3", "code"]
_ONE = np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of lower-cased words as rows of two longs, in order. Fewer words
    than ``size`` are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.empty((0, 2), np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(size, len(words))
    cuts = zip([0, *ends[:-size].tolist()], (ends[size - 1 :] - 1).tolist())
    found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(line[a:b]) for a, b in cuts]), np.uint64)
    return np.unique(found.reshape(-1, 2), axis=0)


def _mixed(found: np.ndarray) -> np.ndarray:
    """As many bits again, of the same hashes."""
    found = (found ^ (found >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def fingerprint(found: np.ndarray) -> tuple[int, ...]:
    """(four quarters of the bits set in more than half of the shingles, code of their number)."""
    if len(found) == 0:
        return 0, 0, 0, 0, 0
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(found), 1 << 14):
        part = found[start : start + (1 << 14)]
        part = np.ascontiguousarray(np.concatenate([part, _mixed(part)], axis=1))
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    tied = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.uint64)
    tied = np.concatenate([tied, _mixed(tied)]).view(np.uint8)
    twice = 2 * ones
    bits = np.where(twice == len(found), np.unpackbits(tied, bitorder="little"), twice > len(found))
    quarters = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64).tolist()
    return *quarters, min(round(math.log2(len(found)) * _SIZE_STEP), THINNED - 1)


def node_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A fingerprint's name, a long."""
    mixed = high * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) + low * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


@lru_cache
def parts(width: int) -> list[list[int]]:
    """The bits of every part. Parts are disjoint while bits last, then drawn anew; as they
    share bits, their number is measured: parts are added until ``FOUND`` of made pairs of
    just that similarity meet in one of them."""
    rng, found = np.random.default_rng(SHINGLE), []
    differ = rng.random((4000, BITS)) < math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    met = np.zeros(len(differ), bool)
    while met.mean() < FOUND:
        if len(found) % (BITS // width) == 0:
            order = rng.permutation(BITS).tolist()
        start = len(found) % (BITS // width) * width
        found.append(order[start : start + width])
        met |= differ[:, found[-1]].sum(axis=1) <= 2
    return found


def _apart(high: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(high[i] ^ high[j]).astype(np.int64) + np.bitwise_count(low[i] ^ low[j])


def named_pairs(variant: np.ndarray, code: np.ndarray, high: np.ndarray, low: np.ndarray, group: int):
    """From rows sorted by variant: pairs of row numbers to verify, which rows stand for the
    others of their variant (all rows of groups up to ``group``), and the near pairs of these
    groups that are not among the first."""
    n = len(variant)
    edges = np.flatnonzero(np.diff(variant)) + 1
    first = np.concatenate([[0], edges]).astype(np.int64)
    sizes = np.diff(np.concatenate([first, [n]]))
    size_of = np.repeat(sizes, sizes)
    stands = np.ones(n, bool)
    near_before = np.full(n, -1), np.full(n, CARRIED + 1)
    near_after = np.full(n, -1), np.full(n, CARRIED + 1)
    few = size_of <= group
    near = [np.empty((0, 2), np.int64)]
    for apart in range(1, int(sizes[sizes <= group].max(initial=1))):
        i = np.flatnonzero((variant[apart:] == variant[:-apart]) & few[:-apart])
        if len(i) == 0:
            break
        j = i + apart
        i, j = (x[np.abs(code[i] - code[j]) <= _SIZES_APART] for x in (i, j))
        bits = _apart(high, low, i, j)
        near.append(np.stack([i, j], 1)[bits <= APART])
        for at, other, (who, least) in ((j, i, near_before), (i, j, near_after)):
            better = (bits <= APART) & (bits < least[at])
            who[at[better]], least[at[better]] = other[better], bits[better]
    left, right = [], []
    for who, _ in (near_before, near_after):
        at = np.flatnonzero(who >= 0)
        left.append(at)
        right.append(who[at])
    i, j = np.concatenate(near).T
    unnamed = (near_after[0][i] != j) & (near_before[0][j] != i)
    for k in np.flatnonzero(sizes > group).tolist():
        rows = np.arange(first[k], first[k] + sizes[k])
        stands[rows] = False
        unread = rows
        while len(unread):  # the first row that no leader is near to leads next
            leader = unread[0]
            stands[leader] = True
            others = unread[1:]
            led = (np.abs(code[others] - code[leader]) <= _SIZES_APART) & (
                _apart(high, low, others, np.full(len(others), leader)) <= APART
            )
            left.append(others[led])
            right.append(np.full(int(led.sum()), leader))
            unread = others[~led]
    return np.concatenate(left), np.concatenate(right), stands, (i[unnamed], j[unnamed])


def _batch(key: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.astype(np.int64)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))],
        names=["key", "high", "low"],
    )


def _links(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs of names travel as rows with a key below zero."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return _batch(np.full(len(pairs), kind), *(np.ascontiguousarray(pairs[:, k]).view(np.uint64) for k in (0, 1)))


def _chains(variant: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """From rows sorted by variant: links between neighbours of the same variant, to keep aside."""
    same = variant[1:] == variant[:-1]
    return _links(ASIDE, names[:-1][same], names[1:][same])


def variants_of(quarters: list[np.ndarray], code: np.ndarray, width: int):
    """(key, row) of all variants: number of the part, bits, and the code of the size."""
    flips = np.concatenate([np.zeros(1, np.uint64), _ONE << np.arange(width, dtype=np.uint64)])
    keys = []
    for number, bits in enumerate(parts(width)):
        word = np.full(len(code), number, np.uint64)
        for bit in bits:
            word = (word << _ONE) | ((quarters[bit // 64] >> np.uint64(bit % 64)) & _ONE)
        keys.append((((word[:, None] ^ flips) << np.uint64(SIZE_BITS)) | code.astype(np.uint64)[:, None]).ravel())
    rows = np.tile(np.repeat(np.arange(len(code)), len(flips)), len(keys))
    return np.concatenate(keys).astype(np.int64), rows


def _emitted(width: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            for start in range(0, batch.num_rows, BLOCK):
                *quarters, code = (c[start : start + BLOCK] for c in columns)
                quarters = [q.view(np.uint64) for q in quarters]
                key, rows = variants_of(quarters, code, width)
                order = np.argsort(key, kind="stable")
                key, h, l = key[order], quarters[0][rows[order]], quarters[1][rows[order]]
                variant = key >> SIZE_BITS
                sizes = np.diff(np.flatnonzero(np.diff(variant, prepend=-1, append=-1)))
                crowd = np.repeat(sizes, sizes) > LOCAL_GROUP
                if crowd.any():
                    some = variant[crowd], key[crowd] & ((1 << SIZE_BITS) - 1), h[crowd], l[crowd]
                    a, b, stands, _ = named_pairs(*some, LOCAL_GROUP)
                    names = node_of(some[2], some[3])
                    yield _links(NAMED, names[a], names[b])
                    yield _chains(some[0], names)
                    stays = ~crowd
                    stays[np.flatnonzero(crowd)[stands]] = True
                    thinned = np.unique(variant[~stays])
                    none = np.zeros(len(thinned), np.uint64)
                    yield _batch((thinned << SIZE_BITS) | THINNED, none, none)
                    key, h, l = key[stays], h[stays], l[stays]
                yield _batch(key, h, l)

    return step


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: pairs (high, low) of names, and the chains of the rows of crowded
    variants and of those of other near pairs that were not named."""
    held: list[np.ndarray] = []

    def compared(key: np.ndarray, high: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        mark = (key & THINNED) == THINNED
        thinned = key[mark] >> SIZE_BITS
        key, high, low = key[~mark], high[~mark], low[~mark]
        if len(key) == 0:
            return
        variant = key >> SIZE_BITS
        a, b, _, (i, j) = named_pairs(variant, key & THINNED, high, low, GROUP)
        sizes = np.diff(np.flatnonzero(np.diff(variant, prepend=-1, append=-1)))
        crowded = (np.repeat(sizes, sizes) > GROUP) | np.isin(variant, thinned)
        crowded[i] = crowded[j] = True
        names = node_of(high, low)
        yield _links(NAMED, names[a], names[b])
        yield _chains(variant[crowded], names[crowded])

    for batch in batches:
        new = [batch.column(0).to_numpy(), *(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))]
        passed = int(np.searchsorted(new[0], 0))
        if passed:
            yield batch.slice(0, passed)
        new = [c[passed:] for c in new]
        held = [np.concatenate(c) for c in zip(held, new)] if held else new
        if len(held[0]):
            done = int(np.searchsorted(held[0] >> SIZE_BITS, held[0][-1] >> SIZE_BITS))
            if done:
                yield from compared(*(c[:done] for c in held))
                held = [c[done:] for c in held]
    if held and len(held[0]):
        yield from compared(*held)


def _printed(rows: DataFrame) -> DataFrame:
    """``place``, ``node``, the fingerprint's quarters and ``code`` of every text."""
    kind = rows.schema["place"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingles(t)) for t in values(batch, "_text")], np.uint64).reshape(-1, 5)
            columns = [np.ascontiguousarray(found[:, k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node_of(*columns[:2])), *[pa.array(c.view(np.int64)) for c in columns]],
                names=["place", "node", *_PRINT],
            )

    quarters = ", ".join(f"{c} bigint" for c in _PRINT)
    return rows.mapInArrow(step, f"place {kind}, node bigint, {quarters}")


def _sets(rows: DataFrame) -> DataFrame:
    """``node`` and the hashes of its text's distinct shingles."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(t)[:, 0]).view(np.int64) for t in values(batch, "_text")]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *found])
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["node", "words"])

    return rows.mapInArrow(step, "node bigint, words array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike. ``texts`` has node and _text."""
    ends = [pairs.select(F.col(end).alias("node")).distinct() for end in ("a", "b")]
    involved = ends[0].union(ends[1]).distinct()
    sets = materialize(_sets(texts.join(involved, "node", "left_semi").select("node", "_text")), "near-sets")
    of_a = sets.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    all_words = F.size("words_a") + F.size("words_b") - shared
    return both.filter(shared >= SIMILARITY * all_words).select("a", "b")


def linked(met: DataFrame, kind: int) -> DataFrame:
    """The pairs (a, b) of names of a kind, once each."""
    return met.filter(F.col("key") == kind).select(F.col("high").alias("a"), F.col("low").alias("b")).distinct()


def open_nodes(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``node`` and ``root`` of all kept aside, of those roots that a link of a chain joins to
    another: all members of a variant that holds more than one root are among them."""
    aside = linked(met, ASIDE)
    for end in ("a", "b"):
        root = F.coalesce("root", end).alias(f"root_{end}")
        own = roots.select(F.col("node").alias(end), "root")
        aside = aside.join(own, end, "left").select(*aside.columns, root)
    aside = materialize(aside, "near-aside")
    ends = [aside.select(F.col(x).alias("node"), F.col(f"root_{x}").alias("root"), F.expr("root_a <> root_b").alias("crosses")) for x in ("a", "b")]
    nodes = materialize(ends[0].union(ends[1]).groupBy("node", "root").agg(F.max("crosses").alias("crosses")), "near-aside-nodes")
    return nodes.join(nodes.filter("crosses").select("root").distinct(), "root", "left_semi").select("node", "root")


def open_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` with different roots, all that can be alike among them: those
    share one of the rarest shingles, as many as a set can lose and one more.

    Rows of a shingle's most frequent root are dealt by a salt, and those of other roots come
    to each part, so no task holds more than ``CROWD`` of them or so.
    """
    sets = _sets(texts.join(nodes, "node", "left_semi").select("node", "_text"))
    words = sets.select("node", F.size("words").alias("size"), F.explode("words").alias("word"))
    words = materialize(words.join(nodes, "node"), "near-words")
    rare = Window.partitionBy("node").orderBy("df", "word")
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("df")).filter("df > 1"), "word").withColumn("rank", F.row_number().over(rare))
    # Shingles of one text alone come first in the order and are met by none.
    alone = F.col("size") - F.count("*").over(Window.partitionBy("node"))
    least = F.ceil(F.col("size") * SIMILARITY - 1e-6)
    head = ranked.withColumn("at", F.col("rank") + alone).filter(F.col("at") <= F.col("size") - least + 1)
    head = materialize(head.select("word", "node", "root", "size", "at"), "near-heads")
    sizes = head.groupBy("word", "root").agg(F.count("*").alias("n")).groupBy("word").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")
    )
    parts = F.ceil(F.col("n") / CROWD).cast("int").alias("parts")
    shared = head.join(sizes.filter("roots > 1").select("word", "main", parts), "word")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    some = shared.filter("root <> main").select("*", each).alias("x")
    every = shared.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("y")
    # Two sets share no more than the first that they share and what follows it in either.
    most = 1 + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    enough = most * (1 + SIMILARITY) >= (F.col("x.size") + F.col("y.size")) * SIMILARITY - 1e-6
    met = some.join(every, F.expr("x.word = y.word AND x.part = y.part AND x.root <> y.root") & enough)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def all_roots(met: DataFrame, texts: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node whose text is alike to another that it met, over any
    number of links: named pairs are verified first, then what they leave open."""
    pairs = materialize(linked(met, NAMED), "near-pairs")
    links = materialize(verified(pairs, texts), "near-links")
    roots = components(links)
    nodes = materialize(open_nodes(met, roots), "near-open")
    rest = materialize(open_pairs(nodes, texts).join(pairs, ["a", "b"], "left_anti"), "near-rest")
    found = materialize(verified(rest, texts), "near-links")
    return roots if found.isEmpty() else components(links.union(found))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of least id of each group of near copies, with its own columns.

    Null texts are empty; texts without words are copies of each other. A null id comes
    after others; of rows with the same id or none the one numbered first stays. An empty
    table stays empty, columns of any name are handed on, and repeated rows are copies.
    """
    rows = keyed(boxed(docs), ["doc", "doc_id", "text"])
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key").alias("place")
    printed = materialize(_printed(rows.select(place, text_bytes().alias("_text"))), "near-prints")
    alike = materialize(
        printed.groupBy("node").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in _PRINT]),
        "near-nodes",
    )
    width = max(LEAST_WIDTH, alike.count().bit_length())
    long = "key bigint, high bigint, low bigint"
    # Blocks and orders follow from the rows, so reruns choose the same leaders.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = alike.select(*_PRINT).repartition(tasks, "q0", "q1").sortWithinPartitions("q0", "q1")
    emitted = placed.mapInArrow(_emitted(width), long)
    # Pairs that are found already are spread; a variant's rows come together.
    target = F.when(F.col("key") < 0, F.xxhash64("high", "low")).otherwise(F.shiftright("key", SIZE_BITS))
    dealt = emitted.repartition(target).sortWithinPartitions("key", "high", "low")
    met = materialize(dealt.mapInArrow(_met, long), "near-met")
    texts = alike.select("node", F.col("place.row_key").alias("row_key")).join(
        rows.select("row_key", text_bytes().alias("_text")), "row_key"
    )
    roots = all_roots(met, texts)
    named = alike.join(roots, "node", "left").select("place", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row_key").alias("row_key"))
    return unboxed(rows.select("row_key", "doc").join(kept, "row_key", "left_semi"))
