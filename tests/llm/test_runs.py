"""Periodic runs against plain searches over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweft.llm import queries, runs
from logweft.llm.common import table


def plain_runs(words, least, times):
    """Every period tried at every place."""
    found = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : i + q]
            smaller = any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                found.add((start, length, q))
    return sorted(found)


def plain_kept(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in drop]


def noisy(rnd, size, letters):
    """Repeats of repeats with a few changes: many runs that touch and overlap."""
    out = []
    while len(out) < size:
        root = [rnd.choice(letters) for _ in range(rnd.randint(1, 9))]
        out += (root * rnd.randint(1, 7))[: rnd.randint(1, 40)]
        if out and rnd.random() < 0.3:
            out += out[-rnd.randint(1, len(out)) :]
    return out[:size]


@pytest.mark.parametrize("least, times", [(24, 3), (2, 2), (6, 2), (10, 4)])
def test_all_runs(least, times):
    rnd = random.Random(least)
    for _ in range(120):
        words = noisy(rnd, rnd.randint(0, 160), [b"a", b"b", b"c"][: rnd.randint(1, 3)])
        want = plain_runs(words, least, times)
        got = runs.word_runs(words, least, times)
        assert [tuple(r) for r in got.tolist()] == want
        kept = runs.kept_words(len(words), got).tolist()
        assert [w for w, k in zip(words, kept) if k] == plain_kept(words, want)


def test_tree_gives_all_common_beginnings():
    rnd = random.Random(4)
    for _ in range(60):
        numbers = [rnd.randint(1, 2) for _ in range(rnd.randint(1, 40))]
        tree = runs.SuffixTree(numbers)
        suffixes = [numbers[i:] for i in range(len(numbers) + 1)]
        assert tree.suffixes.tolist() == sorted(range(len(suffixes)), key=lambda i: suffixes[i])
        pairs = [(i, j) for i in range(len(suffixes)) for j in range(len(suffixes)) if i != j]
        common = [next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[j])) if x != y),
                       min(len(suffixes[i]), len(suffixes[j]))) for i, j in pairs]
        a, b = np.array(pairs).T
        assert tree.extensions(a, b).tolist() == common


def test_grams_of_runs_are_met_again():
    assert runs.gram_length(24, 3) == 9
    for least, times in [(24, 3), (5, 2), (40, 4)]:
        gram = runs.gram_length(least, times)
        for q in range(1, 60):
            size = max(least, times * q)
            assert all(i + q + gram <= size or i >= q for i in range(size - gram + 1))


def test_regions_leave_plain_text_out():
    plain = [f"w{i}".encode() for i in range(300)]
    repeated = plain[:40] + [b"x", b"y", b"z"] * 10 + plain[:40] + plain[100:]
    hashes = np.array([hash(w) for w in repeated]).view(np.uint64)
    assert runs.regions(hashes) == [(40, 70)]


def plain_answer(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(plain_kept(words, found))).hexdigest(),
    )


def test_query_equals_plain_answers(spark, data):
    got = queries.op11_runs(spark, data)
    assert got.columns == (
        "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    )
    docs = [r for r in table(spark, data, "documents").collect() if len((r["text"] or "").split()) < 3000]
    want = {r["doc_id"]: plain_answer(r["doc_id"], r["text"]) for r in docs}
    answers = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(docs) > 100 and {i: answers[i] for i in want} == want
    assert sum(a[1] > 0 for a in answers.values()) > 10


SCHEMA = "doc_id bigint, text string, lang string"


def test_edges(spark):
    cycle = " ".join(["alpha", "beta", "gamma"] * 9)
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))  # a period of 12 701 words, 4.7 times
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, cycle, "en"), (4, cycle, "en"), (None, cycle, "en"),
        (5, "naïve 日本 " * 12, "fr"), (6, "one two", "en"), (7, long, "en"), (8, "x " * 23, "en"), (9, "x " * 24, "en"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ["runs", "n_words", "start", "best"]})
    got = runs.periodic_runs(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]))
    assert of[1] == of[2] == of[3] == [([], "", 0)]
    assert of[4] * 1 == of[None] * 2 == [([(0, 27, 3)], "alpha beta gamma", 27)] * 2
    assert of[5] == [([(0, 24, 2)], "naïve 日本", 24)]
    assert of[6] == [([], "one two", 2)]
    assert of[7][0][0] == [(0, 60_000, 977 * 13)]
    assert of[8] == [([], " ".join("x" * 23), 23)] and of[9] == [([(0, 24, 1)], "x", 24)]
    assert runs.periodic_runs(docs.filter("false")).collect() == []
    named = runs.periodic_runs(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert {r["doc_id"] for r in named} >= {"d4", None}


def test_digest_takes_the_run_with_most_periods(spark):
    rows = [(1, 40, [(0, 30, 10), (5, 45, 15), (9, 24, 8)], "x"), (2, 0, [], "")]
    found = spark.createDataFrame(rows, f"doc_id bigint, n_words bigint, runs {runs.RUNS}, collapsed string")
    got = {r["doc_id"]: r for r in runs.digests(found).collect()}
    assert tuple(got[1])[1:6] == (3, 0, 30, 10, 3000)
    assert tuple(got[2])[1:6] == (0, None, None, None, None)
