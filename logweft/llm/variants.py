"""Spelling variants: words one edit apart, joined on asymmetric chunks.

The shorter word of a pair (of equal lengths: each of both) is cut into two disjoint
chunks, its halves. One inserted, deleted or replaced letter leaves one of them as it is,
so it stands in the other word as a gram, shifted by one place at most: not at all before
the edit, by the difference of lengths after it. So the other word sends its grams at
these places for both lengths a partner can have, and the join is on (length, place,
chunk), with the rest verified.

Grams that stand in many words are not joined. Their words keep the matched part as a
common beginning or end, and the part with the edit is halved again: the same step on a
shorter rest, until few words meet or one letter is left, where the letters there can be
limit how many words meet. Each step is exact, so nothing is dropped, and no group of
words with a frequent beginning is paired up as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweft.llm.common import text_bytes, values
from logweft.session import materialize

LETTERS = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")  # A-Z, a-z and U+00C0 to U+00FF in UTF-8
LEAST_LETTERS = 5
LEAST_COUNT = 3
TIMES = 2  # a form is this many times as frequent as the word
GROUP = 64  # grams that a chunk may meet before its group is halved again
HELD_WORDS = 300_000  # words that a task counts before it passes them on


def counted_words(
    docs: DataFrame,
    edit: Callable[[object, bytes], bytes] | None = None,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word`` and ``n``, its occurrences in all whole texts.

    Words are maximal runs of letters in lower case (A-Z only) with at least
    ``least_letters`` code points. ``edit`` may change a run, given its document's id.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words, counts = list(held), list(held.values())
            held.clear()
            columns = [pa.array(words, pa.binary()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(values(batch, "doc_id"), values(batch, "text")):
                own = Counter(LETTERS.findall(text.lower()))
                if edit is None:
                    held.update(own)
                else:
                    for word, n in own.items():
                        held[edit(doc_id, word)] += n
                if len(held) >= HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    rows = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(step, "word binary, n bigint")
    words = rows.withColumn("word", F.col("word").cast("string")).filter(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def one_letter_less(doc_id: object, word: bytes, one_in: int = 97) -> bytes:
    """A repeatable edit: where the crc32 of ``<doc_id>:<word>`` is divisible, a letter goes."""
    checksum = zlib.crc32(word, zlib.crc32(f"{doc_id}:".encode()))
    if checksum % one_in:
        return word
    letters = word.decode()
    at = checksum % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _halves(low: Column, high: Column) -> Column:
    """The two rests of the edit's part [low, high): its first half matched, or its second."""
    middle = low + F.floor((high - low) / 2).cast("int")
    rest = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return F.array(rest(middle, high), rest(low, middle))


def _entries(words: DataFrame, least_letters: int) -> DataFrame:
    """Both sides' rows before any halving: the edit's part is the whole shorter word.
    ``size`` is the shorter word's length, ``chunks`` the side, ``more`` the letters
    by which this word is longer."""
    size = F.char_length("word")
    sides = [F.struct(F.lit(True).alias("chunks"), F.lit(0).alias("more"))]
    sides += [F.struct(F.lit(False).alias("chunks"), F.lit(more).alias("more")) for more in (0, 1)]
    sided = words.select("word", F.explode(F.array(*sides)).alias("side")).select("word", "side.*")
    return sided.select(
        "word", "chunks", "more", (size - F.col("more")).alias("size"),
        F.lit(0).alias("low"), (size - F.col("more")).alias("high"),
    ).filter(F.col("size") >= least_letters)


def _halved(entries: DataFrame) -> DataFrame:
    """Two rows for each: what stands before and after the part that still holds the edit."""
    rest = F.explode(_halves(F.col("low"), F.col("high")))
    return entries.select("word", "chunks", "more", "size", rest.alias("rest")).select(
        "word", "chunks", "more", "size", "rest.low", "rest.high",
        F.expr("substring(word, 1, rest.low)").alias("before"),
        F.expr("substring(word, rest.high + more + 1)").alias("after"),
    )


KEY = ["size", "low", "high", "before", "after"]


def near_pairs(words: DataFrame, least_letters: int = LEAST_LETTERS, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of distinct words exactly one edit apart, each once."""
    entries, found = _entries(words, least_letters), []
    while True:
        entries = materialize(_halved(entries), "variant-grams")
        counts = entries.groupBy(*KEY).agg(
            F.count_if("chunks").alias("n_chunks"), F.count_if(~F.col("chunks")).alias("n_grams")
        )
        met = counts.filter("n_chunks > 0 AND n_grams > 0")
        crowded = (F.col("n_grams") > group) & (F.col("n_chunks") > 1) & (F.col("high") - F.col("low") > 1)
        few = entries.join(met.filter(~crowded).select(*KEY), KEY, "left_semi")
        left = few.filter("chunks").select(F.col("word").alias("a"), *KEY)
        right = few.filter("NOT chunks").select(F.col("word").alias("b"), *KEY)
        # Where both halves match, the pair belongs to the first: then the later part did not tell them apart.
        own = F.expr("high = size OR substring(a, 1, high) <> substring(b, 1, high)")
        once = F.expr("char_length(a) < char_length(b) OR a < b")
        pairs = left.join(right, KEY).filter(once & own & (F.levenshtein("a", "b", 1) == 1))
        found.append(materialize(pairs.select("a", "b"), "variant-pairs"))
        rest = entries.join(met.filter(crowded).select(*KEY), KEY, "left_semi")
        entries = rest.select("word", "chunks", "more", "size", "low", "high")
        if entries.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of the chain of ``form`` from each word that has one.

    The step doubles each round, and a form is at least twice as frequent as its word,
    so chains have fewer than 64 words and six rounds are the most there can be.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        next_step = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(next_step, "root", "left")
        after = materialize(
            joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "variant-roots",
        )
        steps = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return steps


def grouped(words: DataFrame, least_letters: int = LEAST_LETTERS, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """Per word: ``form`` (its most frequent near word, ties to the first in code-point
    order, if at least ``times`` as frequent, else null), ``root`` (the last form's form,
    the word itself without one), ``n``, ``n_near`` and ``form_n``.

    ``words`` has distinct non-null ``word`` with at least ``least_letters`` code points and ``n``.
    """
    words = materialize(words.select("word", "n"), "variant-words")
    pairs = near_pairs(words, least_letters, group)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = both.join(counts, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    is_form = -F.col("best.less") >= times * F.col("n")
    judged = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "variant-forms",
    )
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, edit: Callable[[object, bytes], bytes] | None = None) -> DataFrame:
    """``grouped`` over the counted words of all whole texts.

    Null and empty texts have no words; repeated rows and ids count each time. An empty
    table gives no rows. Only ``doc_id`` (of any type, null allowed; read by ``edit``) and
    ``text`` are read; other columns can have any name.
    """
    return grouped(counted_words(docs, edit))
