"""Winnowing against a plain version, with and without white space."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import pytest
import xxhash

from logweft.llm import winnow


def hashed(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit.encode(), 42)


def rolled(hashes: list[int]) -> int:
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
    return seed


def units(text: str) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [u for w in words for u in ([w] if len(w) <= winnow.LONGEST else w)]


def plain(text: str) -> list[tuple[int, int]]:
    """(upper bits of the gram, position), chosen window by window."""
    hashes = [hashed(u) for u in units(text)]
    signed = lambda x: (x - (1 << 64) if x >> 63 else x) & ~winnow.POSITIONS
    if not hashes:
        return []
    count = max(len(hashes) - winnow.GRAM + 1, 1)
    grams = [signed(rolled(hashes[i : i + winnow.GRAM])) for i in range(count)]
    found = []
    for start in range(max(count - winnow.SPAN + 1, 1)):
        window = [(grams[i], -i) for i in range(start, min(start + winnow.SPAN, count))]
        gram, place = min(window)
        if (gram, -place) not in found:
            found.append((gram, -place))
    return found


def made(rnd: random.Random, kind: str) -> str:
    if kind == "words":
        return " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20))) for _ in range(rnd.randint(0, 60)))
    if kind == "repeats":
        return "x y " * rnd.randint(0, 40)
    return "".join(chr(rnd.randint(0x4E00, 0x4E40)) for _ in range(rnd.randint(0, 200)))


def prints(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in winnow.fingerprints(docs).collect()}


@pytest.mark.parametrize("kind", ["words", "repeats", "no white space"])
def test_equal_to_the_plain_version(spark, kind):
    rnd = random.Random(kind)
    texts = [made(rnd, kind) for _ in range(40)] + ["", " \t\n", "one", "a b c d", "😀" * 30 + " z " + "q" * 16]
    for at, row in prints(spark, texts).items():
        assert list(zip(row.hashes, row.positions)) == plain(texts[at])


def test_one_character_in_front_of_a_text_without_white_space(spark):
    rnd = random.Random(1)
    text = "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(4000))
    got = prints(spark, [text, "字" + text])
    before, after = set(got[0].hashes), set(got[1].hashes)
    assert len(before & after) >= len(before) - 1


def test_shared_units_share_a_gram(spark):
    rnd = random.Random(2)
    texts = []
    for _ in range(30):
        shared = "".join(chr(rnd.randint(0x3041, 0x3096)) for _ in range(winnow.SPAN + winnow.GRAM - 1))
        for _ in range(2):
            sides = ["".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(rnd.randint(20, 60))) for _ in range(2)]
            texts.append(shared.join(sides))
    got = prints(spark, texts)
    assert all(set(got[2 * i].hashes) & set(got[2 * i + 1].hashes) for i in range(30))


def test_edits_and_likeness_of_plain_sets(spark):
    rnd = random.Random(4)
    texts = [made(rnd, rnd.choice(["words", "no white space"])) for _ in range(12)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in winnow.edited_and_next(docs).collect():
        text, then = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        n = len(text) // 4
        edited = text[: len(text) - n] + then[:n]
        own, changed, following = ({g for g, _ in plain(t)} for t in (text, edited, then))
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(own, changed))
        assert r.near_next == pytest.approx(likeness(own, following))
