"""The pipeline's stages, one after the other, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from logweft.llm import mixing, quality, substrings
from logweft.llm.common import table
from logweft.session import materialize


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """What each stage got and gave: [(name, rows before, rows after)]."""
    docs, labels = (table(spark, data, n) for n in ("documents", "labels"))
    rnd = random.Random(6)
    clean = [r.asDict() for r in docs.join(labels.filter("quality = 1"), "doc_id").select(docs["*"]).orderBy("doc_id").collect()]
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    added = []

    def add(text, row):
        added.append({**row, "doc_id": first + len(added), "text": text})

    long = [r for r in clean if len(r["text"].split()) > 150]
    for row in long[:12]:  # near copies
        words = row["text"].split()
        for _ in range(2):
            changed = list(words)
            for at in rnd.sample(range(len(words)), max(1, len(words) // 120)):
                changed[at] = f"new{rnd.randrange(10**6)}"
            add(" ".join(changed), row)
    passage = " ".join(long[0]["text"].split()[:60])
    for row in long[12:16]:  # a passage that documents share
        add(f"{row['text']} own{row['doc_id']} {passage} end{row['doc_id']}", {**row, "source": long[0]["source"]})
    mixed = [w for r in clean for w in r["text"].split()]
    rnd.shuffle(mixed)
    add(" ".join(mixed[:20_000]), clean[0])  # over many blocks
    folder = str(tmp_path_factory.mktemp("pipeline"))
    made = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in added], docs.schema)
    docs.union(made).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    frame, out = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, frame, folder), name)
        out.append((name, frame, after, folder))
        frame = after
    return {name: (before, after, path) for name, before, after, path in out}


def test_quality_keeps_what_its_model_accepts(spark, stages):
    before, after, folder = stages["quality"]
    scores = quality.quality(before, table(spark, folder, "labels"), F.lit(True))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.filter("score >= 0.5").collect()}


def test_near_duplicates_leave_one_of_each_class(stages):
    before, after, _ = stages["near_duplicates"]
    grams = {}
    for r in before.collect():
        words = words_of((r.text or "").lower())
        grams[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, by_gram, alike = sorted(grams), {}, set()
    for i in ids:
        for g in grams[i]:
            by_gram.setdefault(g, []).append(i)
    for i in ids:
        shared = Counter(j for g in grams[i] for j in by_gram[g] if j < i)
        alike |= {(i, j) for j, n in shared.items() if n >= 0.8 * (len(grams[i]) + len(grams[j]) - n)}
    for i, j in sorted(alike):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    want, got = {find(i) for i in ids}, {r.doc_id for r in after.collect()}
    assert want <= got  # nothing goes that is in no class with one that stays
    assert len(got - want) <= 0.05 * len(ids) and len(ids) - len(want) >= 20
    assert len(ids) - len(got) >= 0.9 * (len(ids) - len(want))


def test_repeated_passages_go(stages):
    before, after, _ = stages["substrings"]
    texts = {r.doc_id: r.text for r in before.collect()}
    size, starts = substrings.WINDOW, Counter()
    for text in texts.values():
        words = words_of(text)
        starts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    got = {r.doc_id: r.text for r in after.collect()}
    assert got.keys() == texts.keys()
    removed = 0
    for i, text in texts.items():
        words = words_of(text)
        covered = set()
        for at in range(len(words) - size + 1):
            if starts[tuple(words[at : at + size])] > 1:
                covered.update(range(at, at + size))
        removed += len(covered)
        assert got[i] == (b" ".join(w for k, w in enumerate(words) if k not in covered).decode() if covered else text)
    assert removed > 0


def test_mixing_takes_what_its_targets_ask(stages):
    before, after, _ = stages["mixing"]
    texts = {r.doc_id: (r.source, words_of(r.text)) for r in before.collect()}
    sizes, taken = Counter(), Counter()
    for source, words in texts.values():
        sizes[source] += len(words)
    for r in after.collect():
        source, words = texts[r.doc_id]
        got = Counter(words_of(r.text))
        assert r.source == source and got <= Counter(words)
        taken[source] += got.total()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > mixing.MOST_REPEATS * sizes[s]}
        target.update({s: mixing.MOST_REPEATS * sizes[s] for s in full} if full else {s: level * weight[s] for s in free})
        free = free - full if full else set()
    for s in order:
        # Blocks of a few words differ by one word each, and a pass draws some of them.
        assert taken[s] == pytest.approx(target[s], rel=0.01, abs=1)
    repeats = Counter(r.doc_id for r in after.collect())
    assert max(repeats.values()) <= mixing.MOST_REPEATS + 1


def test_encoding_gives_the_librarys_ids(stages):
    before, after, _ = stages["encoding"]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(path)), special_tokens={}
    )
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in before.collect())
    rows = after.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
