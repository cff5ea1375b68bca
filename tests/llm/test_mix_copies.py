"""Partial copies of the mix are the words that were drawn."""

from collections import defaultdict

from logweft.llm import mixing


def test_partial_copies_are_the_drawn_words(spark):
    words = {i: [f"d{i}w{j}" for j in range(n)] for i, n in ((1, 3000), (2, 40), (3, 9000), (4, 500))}
    rows = [(i, " ".join(w), "ab"[i > 2]) for i, w in words.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = defaultdict(list)
    for r in mixing.mix(docs)[1].collect():
        drawn[r["doc_id"], r["pass"]].append((r["first_word"], r["n_words"], r["shard"], r["shard_order"]))
    want = []
    for (i, _), spans in drawn.items():
        spans.sort()
        text = " ".join(w for first, n, *_ in spans for w in words[i][first : first + n])
        want.append((*spans[0][2:], i, text))
    got = [(r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect()]
    assert got == [(i, text) for _, _, i, text in sorted(want)]
    partial = [(i, t.split()) for i, t in got if i == 3 and len(t.split()) < len(words[3])]
    assert partial and all(t != words[3][: len(t)] for _, t in partial)
