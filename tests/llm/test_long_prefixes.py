"""Repeats below prefixes that are too frequent for a tree, over many batches."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from logweft.llm import substrings


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_a_hot_passage_over_batches(spark, monkeypatch, partitions):
    monkeypatch.setattr(substrings, "TREE", 3)
    rnd = random.Random(9)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    passage, other = own(90), own(40)
    texts = [own(rnd.randint(0, 50)) + passage + own(rnd.randint(0, 50)) for _ in range(40)]
    texts += [own(5) + other + own(5) + other + passage[:50] for _ in range(2)]
    texts += [passage * 2, passage[10:60], own(80), []]
    starts = Counter()
    for words in texts:
        starts.update(tuple(words[i : i + substrings.WINDOW]) for i in range(len(words) - substrings.WINDOW + 1))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.without_repeats(docs.repartition(partitions)).collect()}
    for i, words in enumerate(texts):
        gone = set()
        for at in range(len(words) - substrings.WINDOW + 1):
            if starts[tuple(words[at : at + substrings.WINDOW])] > 1:
                gone.update(range(at, at + substrings.WINDOW))
        assert got[i] == " ".join(w for k, w in enumerate(words) if k not in gone)
