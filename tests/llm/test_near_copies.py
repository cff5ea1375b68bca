"""Near copies of the pipeline's stage against all pairs of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Row

from logweft.llm import near_copies as near

WORDS = [f"w{i}" for i in range(4000)]


def edited(words: list[str], n: int, rng: random.Random) -> list[str]:
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randrange(10**6)}"
    return words


def similarity(a: str, b: str) -> float:
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_pairs_of_real_similarity(spark):
    rng = random.Random(3)
    rows, alike, unlike = [], [], []
    for pair in range(300):
        base = [rng.choice(WORDS) for _ in range(300)]
        other = edited(base, rng.choice([1, 2, 4, 6, 12, 30]), rng)
        a, b = " ".join(base), " ".join(other)
        rows += [(2 * pair, a), (2 * pair + 1, b)]
        (alike if similarity(a, b) >= 0.8 else unlike).append(2 * pair + 1)
    kept = {r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {2 * p for p in range(300)} | set(unlike)  # nothing below 0.8 goes
    assert len(alike) > 100
    assert len([i for i in alike if i not in kept]) >= 0.95 * len(alike)


def test_hot_group_leaves_one(spark):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(400)]
    rows = [(i, " ".join(edited(base, 2, rng))) for i in range(3000)]
    rows += [(10_000 + i, " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(200)]
    kept = sorted(r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[0] == 0
    assert [i for i in kept if i >= 10_000] == [10_000 + i for i in range(200)]
    assert len(kept) <= 201
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = [sorted(r.doc_id for r in near.keep_one(docs.repartition(n)).collect()) for n in (3, 11)]
    assert again == [kept, kept]


def test_short_null_repeated_and_clashing_rows(spark):
    schema = "doc_id long, text string, node long, row_key string, place string, `a.b` int"
    rows = [
        (4, None, 1, "x", "p", 1),
        (3, "", 2, "x", "p", 1),
        (None, "  \t", 3, "x", "p", 1),
        (5, "one two three four five", 4, "y", None, None),
        (6, "One two three four five", 5, "y", None, None),  # a copy in lower case
        (7, "one two three four five six", 6, "y", None, None),  # half of the shingles
        (8, "one", 7, "y", None, None),
        (8, "one", 7, "y", None, None),
        (9, "two", 8, "y", None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    found = near.keep_one(docs)
    assert found.schema == docs.schema
    assert sorted(found.collect(), key=lambda r: r.doc_id) == [Row(*rows[i]) for i in (1, 3, 5, 6, 8)]


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert near.keep_one(empty).collect() == []
    rows = [("b", "x y z"), ("a", "x y z"), ("c", "z y x")]
    assert sorted(r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()) == ["a", "c"]


def test_small_sets_that_share_a_shingle_stay_apart():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 1 << 63, (1, 2)).astype(np.uint64) for _ in range(3))
    one = near.fingerprint(np.unique(np.concatenate([a, b]), axis=0))
    two = near.fingerprint(np.unique(np.concatenate([a, c]), axis=0))
    assert sum((x ^ y).bit_count() for x, y in zip(one[:2], two[:2])) > near.APART


@pytest.mark.parametrize("width", [24, 28, 34])
def test_parts_hold_the_chance(width):
    rng = np.random.default_rng(2)
    n = 4000
    left = rng.integers(0, 2, (n, near.BITS)).astype(bool)
    right = left ^ (rng.random((n, near.BITS)) < np.arccos(2 * near.SIMILARITY / (1 + near.SIMILARITY)) / np.pi)
    met = np.zeros(n, bool)
    for bits in near.parts(width):
        met |= (left[:, bits] != right[:, bits]).sum(axis=1) <= 2
    assert met.mean() > near.FOUND - 0.03


def groups(texts: list[str], only_met: bool) -> list[int]:
    """The least number of each text's group, where all pairs, or all that meet and are near, are compared."""
    prints = np.array([near.fingerprint(near.shingles(t.encode())) for t in texts], np.uint64).T
    *quarters, code = prints
    key, rows = near.variants_of(list(quarters), code, near.LEAST_WIDTH)
    variants = [set(v.tolist()) for v in (key >> near.SIZE_BITS)[np.argsort(rows, kind="stable")].reshape(len(texts), -1)]
    sizes, root = code.astype(int), list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            apart = sum(int(q[i] ^ q[j]).bit_count() for q in quarters[:2])
            if only_met and (apart > near.APART or abs(sizes[i] - sizes[j]) > near._SIZES_APART or not variants[i] & variants[j]):
                continue
            if root[i] != root[j] and similarity(texts[i], texts[j]) >= near.SIMILARITY:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


@pytest.mark.parametrize(("size", "changed"), [(60, 9), (200, 11)])
def test_no_near_pair_is_lost_in_a_group(spark, size, changed):
    rng = random.Random(size)
    base = [rng.choice(WORDS) for _ in range(300)]
    moved = [(at, f"m{rng.randrange(10**6)}") for at in rng.sample(range(300), 3 * changed)]
    texts = []
    for _ in range(size):  # clusters that overlap: many are near, fewer are alike
        words = list(base)
        for at, word in rng.sample(moved, changed):
            words[at] = word
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near.keep_one(docs).collect()}
    assert set(groups(texts, False)) <= kept <= set(groups(texts, True))


def test_rows_kept_aside_are_few_links_a_text(spark, monkeypatch):
    rng, store, stored = random.Random(7), near.materialize, {}
    monkeypatch.setattr(near, "materialize", lambda rows, name: stored.setdefault(name, store(rows, name)))
    base = [rng.choice(WORDS) for _ in range(300)]
    a_text = []
    for size in (150, 600):
        stored.clear()
        texts = [" ".join(edited(base, 8, rng)) for _ in range(size)]
        near.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        a_text.append(stored["near-met"].filter(f"key < {near.NAMED}").distinct().count() / size)
    assert max(a_text) < 40  # not one for each of the 250 variants that a text emits


def test_roots_next_to_others_are_open(spark):
    """A variant with two roots opens all its rows; chains of one root stay closed."""
    rows = [(near.ASIDE, 1, 2), (near.ASIDE, 2, 3), (near.ASIDE, 3, 4), (near.ASIDE, 3, 4), (near.ASIDE, 7, 8), (near.NAMED, 8, 9)]
    met = spark.createDataFrame(rows, "key long, high long, low long")
    roots = spark.createDataFrame([(2, 1), (1, 1), (8, 7), (7, 7), (5, 4), (4, 4)], "node long, root long")
    found = sorted(map(tuple, near.open_nodes(met, roots).collect()))
    assert found == [(1, 1), (2, 1), (3, 3), (4, 4)]
