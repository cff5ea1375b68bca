"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits meet half-way: blank one of
four 16-bit parts that holds a differing bit, then each side has to change at most one
other bit to reach the same value. So every distinct fingerprint emits, for each part
blanked, itself and its 48 neighbours at distance one: all variants within half the
radius (three halves; the blank part stands for the half bit). Fingerprints are
shuffled on variants, and those that collide are compared.

Equal fingerprints are one row before anything is emitted. Colliding fingerprints are
compared in groups of at most ``GROUP``; a variant shared by more sends its
fingerprints the long way: there one side emits all variants within one changed bit and
the other also those within two, so all of a variant's fingerprints may hang on one that
is at most one bit off, which is one link each and needs no pairs. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logweft.llm.common import boxed, keyed, text_bytes, unboxed, values
from logweft.llm.links import components, forest
from logweft.session import materialize

SHINGLE = 3  # words
SEED = 42
BITS = 64
DISTANCE = 3  # differing bits of linked fingerprints, at most
PARTS = 4
GROUP = 64  # fingerprints of one variant that are compared in place
BLOCK = 1 << 16  # shingles, or fingerprints, that are worked on at once
_ONE = np.uint64(1)
_FLIPS = _ONE << np.arange(BITS, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of lower-cased words, in blocks."""
    words = text.lower().split()
    if not words:
        return
    hashed = xxhash.xxh64_intdigest
    if len(words) < size:
        yield np.array([hashed(b" ".join(words), SEED)], np.uint64)
        return
    for start in range(0, len(words) - size + 1, BLOCK):
        part = words[start : start + BLOCK + size - 1]
        ends = np.cumsum([len(w) + 1 for w in part])
        line = b" ".join(part)
        cuts = zip([0, *ends[:-size].tolist()], (ends[size - 1 :] - 1).tolist())
        yield np.fromiter((hashed(line[a:b], SEED) for a, b in cuts), np.uint64, len(part) - size + 1)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in more than half of all shingles; zero without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, size):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
        n += len(hashes)
    return int((_FLIPS[ones * 2 > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fingerprint`` as a (signed) long, of every whole text."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in values(batch, "_text")], np.uint64)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found.view(np.int64))], names=[*keep, "fingerprint"]
            )

    return rows.mapInArrow(step, f"{kinds}, fingerprint bigint")


def half_radius_variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variants, their fingerprints): each part blanked, none or one other bit changed.
    The blank part holds the part's number."""
    width = BITS // PARTS
    found, whose = [], []
    for part in range(PARTS):
        blank = np.uint64(((1 << width) - 1) << part * width)
        flips = np.concatenate([np.zeros(1, np.uint64), _FLIPS[(_FLIPS & blank) == 0]])
        found.append((((prints & ~blank)[:, None] ^ flips) | np.uint64(part << part * width)).ravel())
        whose.append(np.repeat(prints, len(flips)))
    return np.concatenate(found), np.concatenate(whose)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for start in range(0, len(prints), BLOCK // 64):
            found, whose = half_radius_variants(prints[start : start + BLOCK // 64])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(whose.view(np.int64))], names=["variant", "print"]
            )


def _collided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by variant: verified links, joined up, and the fingerprints of
    crowded variants. A variant can have 49 * 2**16 fingerprints at most."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def compared(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(keys)) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(keys)]]))
        size_of = np.repeat(sizes, sizes)
        crowd = np.unique(prints[size_of > GROUP])
        few = (size_of > 1) & (size_of <= GROUP)
        keys, prints = keys[few], prints[few].view(np.uint64)
        left, right = [], []
        for apart in range(1, int(sizes[sizes <= GROUP].max(initial=1))):
            at = np.flatnonzero(keys[apart:] == keys[:-apart])
            if len(at) == 0:
                break
            near = np.bitwise_count(prints[at] ^ prints[at + apart]) <= DISTANCE
            left.append(prints[at[near]].view(np.int64))
            right.append(prints[at[near] + apart].view(np.int64))
        a, b = forest(np.concatenate(left), np.concatenate(right)) if left else (crowd[:0], crowd[:0])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a, crowd])),
                pa.array(np.concatenate([b, crowd])),
                pa.array(np.arange(len(a) + len(crowd)) >= len(a)),
            ],
            names=["a", "b", "crowded"],
        )

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy()])
        done = np.searchsorted(keys, keys[-1], side="left") if len(keys) else 0
        if done:
            yield compared(keys[:done], prints[:done])
            keys, prints = keys[done:], prints[done:]
    if len(keys):
        yield compared(keys, prints)


def _crowd_links(crowd: DataFrame) -> DataFrame:
    """Links of the fingerprints (a) of crowded variants, through whole balls."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.concatenate([np.zeros(1, np.uint64), _FLIPS])
        i, j = np.triu_indices(BITS, 1)
        two = _FLIPS[i] | _FLIPS[j]
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(prints), 64):
                some = prints[start : start + 64]
                # Fingerprints three bits apart differ in the parity of their bits: one side goes two bits far.
                far = some[np.bitwise_count(some) % 2 == 1]
                parts = [(some, one, True), (far, two, False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([(p[:, None] ^ f).ravel() for p, f, _ in parts]).view(np.int64)),
                        pa.array(np.concatenate([np.repeat(p, len(f)) for p, f, _ in parts]).view(np.int64)),
                        pa.array(np.concatenate([np.full(len(p) * len(f), near) for p, f, near in parts])),
                    ],
                    names=["variant", "print", "near"],
                )

    balls = crowd.select("a").distinct().mapInArrow(step, "variant bigint, print bigint, near boolean")
    middle = balls.filter("near").groupBy("variant").agg(F.min("print").alias("b"))
    both = balls.join(middle, "variant").select(F.col("print").alias("a"), "b")
    return both.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).filter("a <> b")


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join up all fingerprints at most ``DISTANCE`` bits apart.
    ``prints`` has one column of distinct fingerprints."""
    emitted = prints.mapInArrow(_variants, "variant bigint, print bigint")
    dealt = emitted.repartition("variant").sortWithinPartitions("variant")
    found = materialize(dealt.mapInArrow(_collided, "a bigint, b bigint, crowded boolean"), "simhash-links")
    links, crowd = found.filter("NOT crowded").select("a", "b"), found.filter("crowded")
    return links if crowd.isEmpty() else links.union(_crowd_links(crowd))


def print_classes(printed: DataFrame, first: str) -> DataFrame:
    """``fingerprint`` and the least ``first`` of all rows that its links reach."""
    alike = materialize(printed.groupBy("fingerprint").agg(F.min(first).alias("first")), "simhash-prints")
    roots = components(print_links(alike.select("fingerprint")))
    named = alike.join(roots, alike["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return named.join(least, "root").select("fingerprint", "component")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` per document.

    Null texts are empty; texts without words have fingerprint zero and are linked
    like others; repeated rows are documents of their own. A null id is no
    component's id unless all of its ids are null. Other columns are not read.
    """
    printed = materialize(fingerprints(docs, ["doc_id"], size), "simhash")
    classes = print_classes(printed, "doc_id")
    return printed.join(classes, "fingerprint").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The document of least id of each group, with its own columns."""
    rows = keyed(boxed(docs), ["doc", "doc_id", "text"])
    printed = materialize(
        fingerprints(rows, ["doc_id", "row_key"], size).select(
            "fingerprint", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key").alias("place")
        ),
        "simhash",
    )
    kept = print_classes(printed, "place").select(F.col("component.row_key").alias("row_key")).distinct()
    return unboxed(rows.select("row_key", "doc").join(kept, "row_key", "left_semi"))
