"""Toxicity after noisy-channel deobfuscation.

Texts are folded first: full-width and accented letters become plain ones, and letters of
other scripts that look like Latin ones do so in words that hold Latin letters. A word that
hides (leetspeak, letters set apart by any white space, letters repeated) is read as a lattice:
every run of a character may stand for one of some letters, for one or two of them, or
for nothing, at a cost. The best path under a character trigram model is the restored
word. The text of restored words is then scored: words and beginnings of words that
labelled documents show to be toxic weigh, and a small logistic model turns the weights
of a document into a chance.

The character model counts every text that may be learned from, in one pass with
tables of fixed size; toxic words count in it as a part of their own. Weights and the
logistic model are fitted on at most about ``SAMPLE_ROWS`` labelled documents; each half
of them is measured with weights from the other half, so weights are not judged by the
rows they come from.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm.common import text_bytes, values
from logweft.llm.quality import labelled

SAMPLE_ROWS = 16_000
DOUBT = 2.0
MOST_TERMS = 5_000  # terms of the model
LEAST_DOCUMENTS = 3  # of the sample that hold a term
MOST_WORDS = 400_000  # remembered words of a worker, in two generations
PREFIXES = (4, 5, 6)
SYMBOLS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, KINDS = 26, 27, 28  # codes beside the letters
TOXIC_SHARE = 0.5  # of the character model that toxic words make up

#: What a character may stand for, beside itself. Fixed values.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "*": "aeiou",
    "#": "aeiou",
}
#: Letters of other scripts that look like Latin ones (lower-cased), and those. Fixed values.
LOOKS_LIKE = str.maketrans(
    "авекмнорстухіјѕԁһαεικνορτυχωη",
    "abekmhopctyxijsdhaeikvoptuxwn",
)
APART = " .-_*~'"  # may stand between the letters of a word
SWAP, DROP, JOIN, KEEP = 1.0, 0.5, 0.5, 4.0  # costs: as a letter, between letters, fewer repeats, unread
SETTLED = 64  # runs after which what all paths have in common is put aside

_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_ACCENTS = re.compile("[\u0300-\u036f\u00ad\u200b\u2060\ufeff]")
_LATIN_WORD = re.compile(r"\S*[a-z]\S*")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_HIDDEN = re.compile(r"[^\W\d_].*?[0-9@$!|+(*#.\-_~'].*?[^\W\d_]|[0-9@$!|+(][^\W\d_]{2}|[^\W\d_]{2}[0-9@$|+(]")


def folded(text: str) -> str:
    """Lower-cased, without accents, compatibility forms and look-alikes in Latin words."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower())
    text = unicodedata.normalize("NFC", _ACCENTS.sub("", text)).lower()
    if text.translate(LOOKS_LIKE) == text:
        return text
    return _LATIN_WORD.sub(lambda m: m[0].translate(LOOKS_LIKE), text)


def bare(word: str) -> str:
    """A lower-case word without the marks around it."""
    return word.rstrip(".,;:!?\"'()[]*&%$#|<>-_").lstrip(".,;:?\"'()[]&%#<>-_*")


def looks_hidden(word: str) -> bool:
    return not word.isalpha() and _HIDDEN.search(word) is not None or _TRIPLE.search(word) is not None


class CharacterModel:
    """Trigram costs from counts of KINDS**3 codes, smoothed by shorter histories."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        one = (cube.sum((0, 1)) + 0.5) / (cube.sum() + 0.5 * KINDS)
        pairs = cube.sum(0)
        two = (pairs + 10 * one) / (pairs.sum(1, keepdims=True) + 10)
        self.cost = -np.log((cube + 5 * two) / (cube.sum(2, keepdims=True) + 5))

    @staticmethod
    def of_words(words: dict[str, float]) -> np.ndarray:
        counts = np.zeros(KINDS**3)
        for word, weight in words.items():
            codes = [EDGE, EDGE, *(code_of(c) for c in word), EDGE]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                counts[(a * KINDS + b) * KINDS + c] += weight
        return counts

    @staticmethod
    def choices(char: str, length: int) -> list[tuple[str, float]]:
        """What a run of ``length`` equal characters may be, and the cost of each."""
        if char == " ":
            return [(" ", 0.0), ("", DROP)]
        found = [(char * min(length, 2), 0.0 if char.isalpha() else KEEP)]
        if length > 1 and char.isalpha():
            found.append((char, JOIN if length > 2 else 3 * JOIN))
        for letter in STANDS_FOR.get(char, ""):
            found += [(letter * n, SWAP + (JOIN if n < length else 0.0)) for n in range(1, min(length, 2) + 1)]
        if char in APART:
            found.append(("", DROP))
        return found

    def restore(self, word: str) -> str:
        """The best path through the word's lattice. A space may be a border of two words,
        at the cost of the first one's end; the second begins like any word."""
        settled: list[str] = []
        best: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", word, re.S)]
        for place, (char, length) in enumerate(runs):
            choices = self.choices(char, length)
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, read) in best.items():
                for letters, own in choices:
                    x, y, total = a, b, cost + own
                    if letters == " ":
                        total, x, y = total + self.cost[a, b, EDGE], EDGE, EDGE
                    for c in letters.strip(" "):
                        z = code_of(c)
                        total += self.cost[x, y, z]
                        x, y = y, z
                    known = after.get((x, y))
                    if known is None or (total, read + letters) < known:
                        after[x, y] = (total, read + letters)
            best = after
            if place % SETTLED == SETTLED - 1:
                common = commonprefix([read for _, read in best.values()])
                settled.append(common)
                best = {k: (cost, read[len(common) :]) for k, (cost, read) in best.items()}
        last = min((cost + self.cost[a, b, EDGE], read) for (a, b), (cost, read) in best.items())[1]
        return "".join(settled) + last


def code_of(char: str) -> int:
    place = ord(char) - 97
    return place if 0 <= place < 26 else OTHER


_CODES = np.full(256, OTHER, np.int64)
_CODES[97:123] = np.arange(26)
_CODES[list(b" \t\n\x0b\x0c\r")] = EDGE


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over whole lower-cased texts: KINDS**3 numbers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, np.int64)
        for batch in batches:
            for text in values(batch, "_text"):
                codes = _CODES[np.frombuffer(b"  " + text.lower() + b" ", np.uint8)]
                total += np.bincount((codes[:-2] * KINDS + codes[1:-1]) * KINDS + codes[2:], minlength=KINDS**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(KINDS**3)), pa.array(total)], names=["code", "n"])

    rows = docs.select(text_bytes().alias("_text")).mapInArrow(step, "code bigint, n bigint")
    got = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(KINDS**3)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out


def terms_of(word: str) -> list[str]:
    """What of a restored word may weigh: itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if word else []


@dataclass
class ToxicityModel:
    characters: CharacterModel
    weights: dict[str, float]
    slope: np.ndarray = field(default_factory=lambda: np.zeros(4))
    intercept: float = 0.0

    def __post_init__(self) -> None:
        self._young: dict[str, float] = {}
        self._old: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_young", "_old")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def read(self, word: str) -> str:
        word = bare(word)
        return self.characters.restore(word) if looks_hidden(word) else word

    def _weigh(self, word: str) -> float:
        known = self._old.get(word)
        if known is None:
            known = max((self.weights.get(t, 0.0) for t in terms_of(self.read(word))), default=0.0)
        if len(word) <= 64:
            if len(self._young) >= MOST_WORDS // 2:
                self._old, self._young = self._young, {}
            self._young[word] = known
        return known

    def set_apart(self, text: str) -> list[str]:
        """Words whose letters stand apart, restored."""
        return [w for m in _SPACED.finditer(text) for w in self._together(m).split()]

    def _together(self, spaced: re.Match) -> str:
        letters = " ".join(spaced[0].split())
        if not letters.isascii() and _LATIN_WORD.search(letters):
            letters = letters.translate(LOOKS_LIKE)
        return self.characters.restore(bare(letters))

    def restored(self, text: str) -> str:
        """The whole text as it is scored."""
        joined = _SPACED.sub(self._together, folded(text))
        return " ".join(map(self.read, joined.split()))

    def measure(self, text: str) -> list[float]:
        text = folded(text)
        words, weigh = text.split(), self._weigh
        found = []
        for word in words:
            known = self._young.get(word)
            found.append(weigh(word) if known is None else known)
        found += [max((self.weights.get(t, 0.0) for t in terms_of(w)), default=0.0) for w in self.set_apart(text)]
        weights = np.array(found)
        if len(weights) == 0:
            return [0.0] * 4
        strong = weights[weights > 1]
        return [float(weights.max()), float(np.log1p(strong.sum())), float(np.log1p(len(strong))), len(strong) / len(weights)]

    def score(self, measured: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measured @ self.slope + self.intercept, -30, 30)))


def _logistic(measured: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Newton's method on a few columns; constant labels give their smoothed share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    width = measured.shape[1]
    if len(labels) == 0 or labels.min() == labels.max():
        return np.zeros(width), float(np.log(share / (1 - share))) if len(labels) else 0.0
    x = np.column_stack([measured, np.ones(len(labels))])
    w = np.zeros(width + 1)
    keep = np.diag([ridge] * width + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (labels - p) - keep @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _term_counts(sample: DataFrame, characters: CharacterModel) -> DataFrame:
    """Documents with a term, by half of the sample and label."""
    reader = ToxicityModel(characters, {})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, label, half in zip(values(batch, "_text"), values(batch, "_label"), values(batch, "_half")):
                lower = folded(text.decode("utf-8", "replace"))
                words = {*map(reader.read, set(lower.split())), *reader.set_apart(lower)}
                counts.update((t, half, label) for t in {t for w in words for t in terms_of(w)})
            columns = list(zip(*counts)) or [[], [], []]
            kinds = [pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(list(c), k) for c, k in zip(columns, kinds)), pa.array(list(counts.values()), pa.int64())],
                names=["term", "half", "label", "n"],
            )

    return sample.mapInArrow(step, "term string, half int, label int, n bigint")


def _weights(held: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much likelier a term is in toxic documents, as a logarithm, less ``DOUBT``
    standard errors of it, so that rare chances weigh little; not below zero."""
    a, b = held + 0.1, clean + 0.5
    sure = np.log(a / (n_toxic + 0.2) / (b / (n_clean + 1))) - DOUBT * np.sqrt(1 / a + 1 / b)
    return np.where(held > 0, np.maximum(sure, 0), 0)


def _of_several_words(held: dict[str, float]) -> set[str]:
    """The terms without those beginnings that are toxic by a single word."""
    alone = {f"{word[:n]}*" for word, count in held.items() for n in PREFIXES
             if len(word) > n and word[-1] != "*" and count >= 0.8 * held.get(f"{word[:n]}*", np.inf)}
    return held.keys() - alone


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on documents that meet ``learn_from``, a condition on ``doc_id``."""
    own = docs.select("doc_id", "text").filter(learn_from)
    general = character_counts(own)
    characters = CharacterModel(general)
    pool = labelled(labels, "toxic").filter(learn_from)
    share = min(1.0, rows / max(1, pool.count()))
    chosen = pool.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    sample = own.join(F.broadcast(chosen), "doc_id").select(
        text_bytes().alias("_text"), "_label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("_half")
    )
    sizes = {(r["_half"], r["_label"]): r["n"] for r in sample.groupBy("_half", "_label").agg(F.count("*").alias("n")).collect()}
    size = lambda label, halves=(0, 1): sum(sizes.get((h, label), 0) for h in halves)
    cell = lambda half, label: F.sum(F.when((F.col("half") == half) & (F.col("label") == label), F.col("n")).otherwise(0))
    by_term = _term_counts(sample, characters).groupBy("term").agg(
        *[cell(h, v).alias(f"n{h}{v}") for h in (0, 1) for v in (0, 1)]
    )
    held, clean = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    surplus = held * F.log((held + 0.1) * (size(0) + 1) / ((clean + 0.5) * (size(1) + 0.2)))
    top = by_term.filter(held >= LEAST_DOCUMENTS).withColumn("surplus", surplus).filter("surplus > 0")
    got = top.orderBy(F.desc("surplus"), "term").limit(MOST_TERMS).toArrow()
    terms = got.column("term").to_pylist()
    n = {name: got.column(name).to_numpy().astype(float) for name in ("n00", "n01", "n10", "n11")}
    several = _of_several_words(dict(zip(terms, n["n01"] + n["n11"])))
    at = [i for i, term in enumerate(terms) if term in several]
    terms, n = [terms[i] for i in at], {name: column[at] for name, column in n.items()}
    whole = dict(zip(terms, _weights(n["n01"] + n["n11"], n["n00"] + n["n10"], size(1), size(0))))
    toxic = CharacterModel.of_words({t: 1.0 for t, w in whole.items() if w > 2 and t.isascii() and t.isalpha()})
    if toxic.sum():
        scale = TOXIC_SHARE / (1 - TOXIC_SHARE) * max(general.sum(), 1) / toxic.sum()
        characters = CharacterModel(general + toxic * scale)
    halves = [
        ToxicityModel(characters, dict(zip(terms, _weights(n[f"n{h}1"], n[f"n{h}0"], size(1, (h,)), size(0, (h,))))))
        for h in (0, 1)
    ]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(values(batch, "_text"), values(batch, "_half"))
            found = [halves[1 - h].measure(t.decode("utf-8", "replace")) for t, h in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["measured", "_label"]
            )

    seen = sample.mapInArrow(step, "measured array<double>, _label int").toArrow()
    matrix = np.array(seen.column("measured").to_pylist(), dtype=float).reshape(-1, 4)
    target = np.array(seen.column("_label").to_pylist(), dtype=float)
    order = np.lexsort([target, *matrix.T])
    return ToxicityModel(characters, whole, *_logistic(matrix[order], target[order]))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id`` and ``score`` per document.

    Null texts are empty, and an empty text has no weights; repeated rows each get
    their score; without labels every score is 0.5. Of ``docs`` only ``doc_id`` and
    ``text`` are read, and the id only to choose rows to learn from.
    """
    model = train(docs, labels, learn_from, rows)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.measure(t.decode("utf-8", "replace")) for t in values(batch, "_text")]
            scores = model.score(np.array(found, dtype=float).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_bytes().alias("_text")).mapInArrow(step, f"doc_id {kind}, score double")


def restored_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id`` and the deobfuscated ``text``: lower-case words joined by one space."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.restored(t.decode("utf-8", "replace")) for t in values(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_bytes().alias("_text")).mapInArrow(step, f"doc_id {kind}, text string")
