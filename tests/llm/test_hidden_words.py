"""Hidden words: gaps, look-alikes, and Viterbi against all paths of a lattice."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from logweft.llm import toxicity

WORDS = {"idiot": 5.0, "ass": 5.0, "moron": 5.0}


@pytest.fixture(scope="module")
def model():
    usual = dict.fromkeys("the quick brown fox has seen you and a lazy dog in its house as usual".split(), 40.0)
    return toxicity.ToxicityModel(
        toxicity.CharacterModel(toxicity.CharacterModel.of_words({**usual, **dict.fromkeys(WORDS, 60.0)})), WORDS
    )


@pytest.mark.parametrize(
    "text",
    [
        "you i d i o t",
        "you i  d  i  o  t here",
        "i\nd\ni\no\nt",
        "i\td \n i o   t",
        "a s s",
        "іdiot",  # Cyrillic
        "you і d і о t",
        "mοron",  # Greek
        "ｉｄｉｏｔ",  # full width
        "ïdïöt",
        "id​iot",
        "1d10t",
        "iiidiooot",
        "i.d.i.o.t",
    ],
)
def test_hidden_words_are_found(model, text):
    assert model.measure(text)[0] == 5.0


@pytest.mark.parametrize("text", ["", "the quick brown fox", "a 1 b 2", "сор и вор", "x = y", "été à la maison"])
def test_plain_words_are_left_alone(model, text):
    assert model.measure(text)[0] == 0.0


def test_texts_of_another_script_stay():
    assert toxicity.folded("сор и вор") == "сор и вор"
    assert toxicity.folded("한국어 が 日本") == "한국어 が 日本"


def all_paths(model, word):
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", word, re.S)]
    for path in itertools.product(*(model.choices(c, n) for c, n in runs)):
        read, cost = "".join(p for p, _ in path), sum(c for _, c in path)
        a = b = toxicity.EDGE
        for char in [*read, None]:
            z = toxicity.EDGE if char in (None, " ") else toxicity.code_of(char)
            cost += model.cost[a, b, z]
            a, b = (toxicity.EDGE, toxicity.EDGE) if char == " " else (b, z)
        yield cost, read


def test_the_best_of_all_paths(model):
    rnd = random.Random(8)
    for _ in range(300):
        word = "".join(rnd.choice("idota1035@$!.* ss") for _ in range(rnd.randint(1, 7))).strip() or "a"
        paths = list(all_paths(model.characters, word))
        least = min(cost for cost, _ in paths)
        best = {read for cost, read in paths if cost < least + 1e-9}
        assert model.characters.restore(word) in best
