"""Packing against all subsets, whole round trips and the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweft.llm import packing, queries
from logweft.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string"


def test_fullest_equals_all_subsets():
    rnd = random.Random(1)
    for _ in range(200):
        counts = Counter({rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))})
        room = rnd.randint(0, 60)
        sums = [
            sum(n * x for n, x in zip(taken, counts))
            for taken in product(*(range(n + 1) for n in counts.values()))
        ]
        got = packing.fullest(counts, room)
        assert all(0 < n <= counts[x] for x, n in got.items())
        assert sum(n * x for x, n in got.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("lengths", [[700] * 999, [1] * 5000, [1023] * 40, [512] * 9, "random", "few", []])
def test_windows_are_full_and_lose_nothing(lengths):
    rnd = random.Random(2)
    if lengths == "random":
        lengths = [rnd.randint(1, 1023) for _ in range(4000)]
    if lengths == "few":
        lengths = [rnd.choice([3, 500, 501, 700]) for _ in range(300)]
    tails = [(i, 1024, n) for i, n in enumerate(lengths)]
    windows, left = packing.packed(tails, 1024)
    assert all(sum(p[2] for p in filled) == 1024 for filled in windows)
    assert sum(p[2] for p in left) < 1024
    parts = defaultdict(list)
    for filled in [*windows, left]:
        for doc, start, length in filled:
            parts[doc].append((start, start + length))
    for doc, start, length in tails:
        own = sorted(parts[doc])
        assert own[0][0] == start and own[-1][1] == start + length
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))
    if len(lengths) == 4000:
        assert sum(map(len, parts.values())) < 4000 * 1.15  # few tails are cut


def test_last_tokens_stand_in_powers_of_two():
    got = packing.powers([(1, 0, 300), (2, 5, 77), (3, 9, 1)])
    assert [sum(p[2] for p in filled) for filled in got] == [256, 64, 32, 16, 8, 2]
    assert [p for filled in got for p in filled][:3] == [(1, 0, 256), (1, 256, 44), (2, 5, 20)]


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", " " * 300_000 + "x", "naïve 日本語 \U0001f600\r\n\tX's 12", "a" * 50_000])
def test_ids_are_the_library_s(text):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder._ranked is not None
    assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(open(path, encoding="utf-8").read())
    assert encoder._ranked is None
    assert encoder.ids("Some Words here").tolist() == Tokenizer.from_file(path).encode("Some Words here", add_special_tokens=False).ids


def checked(rows, wanted, window=1024):
    """Pieces hold each document's ids once, sequences are gapless and hardly padded."""
    documents, places = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"], r["doc_tokens"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc_id, n), own in documents.items():
        ids = wanted[doc_id]
        own = sorted(own, key=lambda r: r["start"])
        assert n == len(ids) and [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for own in places.values():
        own.sort()
        size = sum(n for _, n in own)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert size <= window and size & (size - 1) == 0
    assert {d for d, _ in documents} == set(wanted)


def library_ids(texts):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 5000])
def test_query_packs_every_id_once(spark, data, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    got = queries.op12_pack(spark, data)
    assert got.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    checked(got.collect(), library_ids(texts))


def test_blocks_hand_their_last_tokens_on():
    packer = packing._Packer(8)
    out = []
    for doc, size in enumerate([5, 13, 3, 21, 7, 7, 1]):
        packer.add(f"d{doc}", np.arange(size, dtype=np.uint32))
        out += list(packer.passed_on(False))
        assert sum(len(d[2]) for d in packer.documents.values()) < 8
    assert all(sum(p[2] for p in filled) == 8 for filled in out)
    out += list(packer.passed_on(True))
    assert sum(p[2] for filled in out for p in filled) == 57


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = {1: None, 2: "", 3: " \n\t", 5: long, 6: "same", 7: "日本語 naïve", None: "no id"}
    rows = [(i, t, "en") for i, t in texts.items()] + [(6, "same", "en")] * 3000
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ["ids", "start", "length", "offset"]})
    got = packing.pieces(docs, PATH, 0).collect()
    wanted = library_ids(texts)
    total = sum(len(wanted[r[0]]) for r in rows)
    assert sum(r["length"] for r in got) == total
    for doc_id in (1, 2, 3, 5, 7, None):
        own = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == doc_id)
        assert [x for _, ids in own for x in ids] == wanted[doc_id]
    assert sum(r["length"] for r in got if r["doc_id"] == 6) == 3001 * len(wanted[6])
    assert packing.pieces(docs.filter("false"), PATH, 0).collect() == []
    named = packing.pieces(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), PATH, 0)
    assert {"d5", None} <= {r["doc_id"] for r in named.collect()}


def test_sequences_are_the_pieces_in_order(spark, data):
    docs = table(spark, data, "documents")
    own = defaultdict(list)
    for r in packing.pieces(docs, PATH, 0).collect():
        own[r["sequence_id"]].append((r["offset"], r["ids"]))
    for r in packing.sequences(docs, PATH, 0, pad_id=50_000, window=1024).collect():
        parts = sorted(own.pop(r["sequence_id"]))
        assert r["starts"] == [o for o, _ in parts] and r["ids"] == [x for _, ids in parts for x in ids]
        assert r["n_tokens"] == len(r["ids"])
    assert not own
