"""Spelling variants against a plain search of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweft.llm import queries, variants
from logweft.llm.common import table


def near_of(words):
    """Near words through all words with one letter left out or replaced by a blank."""
    holes, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if (shorter := w[:i] + w[i + 1 :]) in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    return near


def plain(counts, times=2):
    near, forms = near_of(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items()}


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_equals_plain_answers(spark, data):
    got = queries.op13_variants(spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    answers = [tuple(r) for r in got.collect()]
    assert len(answers) == len(set(answers)) and set(answers) == plain(plain_words(rows))
    assert any(r[1] and r[2] != r[1] for r in answers) or sum(bool(r[1]) for r in answers) > 20


@pytest.mark.parametrize("letters, group", [("ab", 2), ("abé", 4), ("abcdefgh", 64), ("a", 1)])
def test_all_pairs_at_any_group_size(spark, letters, group):
    rnd = random.Random(group)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(400)}
    words |= {"prefixed" + "".join(rnd.choice(letters) for _ in range(4)) for _ in range(100)}
    words |= {"a" * n for n in range(5, 40)}
    counts = {w: rnd.choice([3, 5, 6, 12, 24, 100]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [tuple(r) for r in variants.grouped(frame, group=group).collect()]
    assert len(got) == len(counts) and set(got) == plain(counts)


def test_pairs_come_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "abaaaa", "xaayz", "xaaayz", "xbayz"]
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    for group in (1, 64):
        pairs = [tuple(sorted(r)) for r in variants.near_pairs(frame, group=group).collect()]
        want = {tuple(sorted((w, x))) for w, near in near_of(dict.fromkeys(words, 3)).items() for x in near}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_a_frequent_beginning_is_not_paired_up(spark):
    """3 000 words with one first half: candidates stay near the number of words."""
    rnd = random.Random(9)
    words = {"beginnin" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(3000)}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    entries = variants._entries(frame, 5)
    most = entries = variants._halved(entries)
    counts = most.groupBy(*variants.KEY).agg(F.count_if("chunks").alias("a"), F.count_if(~F.col("chunks")).alias("b"))
    assert counts.agg(F.max("b")).first()[0] == len(words)
    again = variants._halved(entries.filter("low > 0")).groupBy(*variants.KEY).agg(F.count_if(~F.col("chunks")).alias("b"))
    assert again.agg(F.max("b")).first()[0] < 64
    assert variants.near_pairs(frame).count() == sum(map(len, near_of(words).values())) // 2


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " 12 \t"), (None, "Über über ÜBER naïve naive"), (4, "color colour " * 4), (4, "color"),
            (5, "naive naive NAIVE naïve naïve x" * 3), (6, "z" * 5000 + " " + "z" * 5001), (6, ("z" * 5000 + " " + "z" * 5001 + " ") * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ["word", "n", "size"]})
    counts = Counter()
    for _, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            counts["".join(c.lower() if c <= "Z" else c for c in run)] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert {tuple(r) for r in variants.variants(docs).collect()} == want
    edited = plain(plain_words(rows))
    assert {tuple(r) for r in variants.variants(docs, variants.one_letter_less).collect()} == edited
    assert variants.variants(docs.filter("false")).collect() == []


def test_roots_of_a_long_chain(spark):
    chain = [f"w{i:03}" for i in range(63)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {tuple(r) for r in variants.roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}
