"""Document fingerprints by winnowing, in built-in expressions only.

A text is cut into units: words of at most ``LONGEST`` characters, and every character of
longer runs without white space, so that no cut depends on where a run begins. Units are
hashed, every ``GRAM`` in a row make a gram, and of every ``SPAN`` grams in a row the least
is chosen, the last of equals. Two texts that share ``SPAN + GRAM - 1`` units in a row
therefore share a chosen gram, with or without white space. Positions of chosen grams are
kept with them.

A gram is the upper 36 bits of its hash; the lower 28 hold its position, reversed, so
that the least value of a window is the last of its equal grams. A Spark array of longs
ends at 2**28 elements, so no position is longer than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft.llm.common import keyed
from logweft.session import materialize

GRAM = 5  # units of a gram
SPAN = 12  # grams of a window
LONGEST = 16  # characters of a word that is one unit
POSITIONS = (1 << 28) - 1
_IN_WORD = r"[^\x20\x09-\x0D]"
UNIT = rf"(?<!{_IN_WORD}){_IN_WORD}{{1,{LONGEST}}}+(?!{_IN_WORD})|{_IN_WORD}"


def chosen_grams(text: Column) -> Column:
    """The chosen grams of a text with their positions, in order, as packed longs.
    A text of fewer units than a gram has one gram of them all; one without has none."""
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))

    def bound(value: Column, use) -> Column:  # evaluates ``value`` once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def grams(hashes: Column) -> Column:
        rolled = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - GRAM),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(GRAM)]),
        )
        return F.when(F.size(hashes) >= GRAM, rolled).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(
            F.array().cast("array<bigint>")
        )

    def packed(found: Column) -> Column:
        place = lambda i: F.lit(POSITIONS) - (i.bitwiseAND(F.lit(POSITIONS)))
        return F.transform(found, lambda g, i: g.bitwiseAND(F.lit(~POSITIONS)).bitwiseOR(place(i).cast("bigint")))

    def winnowed(rows: Column) -> Column:
        least = F.transform(
            F.sequence(F.lit(1), F.size(rows) - SPAN + 1), lambda i: F.array_min(F.slice(rows, i, F.lit(SPAN)))
        )
        few = F.filter(F.array(F.array_min(rows)), lambda x: x.isNotNull())
        return F.array_distinct(F.when(F.size(rows) > SPAN, least).otherwise(few))

    return bound(F.transform(units, lambda u: F.xxhash64(u)), lambda h: bound(packed(grams(h)), winnowed))


def gram_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: x.bitwiseAND(F.lit(~POSITIONS))))


def gram_positions(chosen: Column) -> Column:
    return F.transform(chosen, lambda x: F.lit(POSITIONS) - x.bitwiseAND(F.lit(POSITIONS)))


def digest(chosen: Column) -> Column:
    return F.md5(F.array_join(F.transform(chosen, lambda x: F.hex(x)), ""))


def likeness(left: Column, right: Column) -> Column:
    """Shared grams among all of both sets; 1 for two empty ones."""
    both, shared = F.size(left) + F.size(right), F.size(F.array_intersect(left, right))
    return F.when(both == 0, 1.0).otherwise(shared / (both - shared))


def fingerprints(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, ``hashes`` and ``positions`` of the chosen grams, and ``fingerprint``."""
    chosen = chosen_grams(F.coalesce("text", F.lit("")))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], chosen.alias("_chosen"))
    return rows.select(
        *keep,
        F.transform("_chosen", lambda x: x.bitwiseAND(F.lit(~POSITIONS))).alias("hashes"),
        gram_positions(F.col("_chosen")).alias("positions"),
        digest(F.col("_chosen")).alias("fingerprint"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Every document with its place in ascending id: ``prev_key`` and the length of the
    document before it. After the last comes the first.

    Rows are dealt to ranges of ids and numbered in each; only the first and last of each
    range look beyond it. ``rows`` has row_key, doc_id and n_chars.
    """
    dealt = rows.repartitionByRange("doc_id", "row_key").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "id-ranges")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row_key")
    before = dealt.select(
        "*",
        F.lag("row_key").over(inside).alias("prev_key"),
        F.lag("n_chars").over(inside).alias("prev_chars"),
    )
    last = F.struct(F.col("doc_id").isNotNull(), "doc_id", "row_key")
    ends = dealt.groupBy("part").agg(
        F.max_by("row_key", last).alias("end_key"), F.max_by("n_chars", last).alias("end_chars")
    )
    over_parts, all_parts = Window.orderBy("part"), Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    passed_on = ends.select(
        "part",
        *[
            F.coalesce(F.lag(c).over(over_parts), F.last(c).over(all_parts)).alias(f"over_{c}")
            for c in ("end_key", "end_chars")
        ],
    )
    return before.join(passed_on, "part").select(
        "row_key",
        "doc_id",
        "n_chars",
        F.coalesce("prev_key", "over_end_key").alias("prev_key"),
        F.coalesce("prev_chars", "over_end_chars").alias("prev_chars"),
    )


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by
    the beginning of the next document, and its likeness to both.

    Null texts are empty; repeated rows follow each other; null ids come first; a single
    document is its own next. Other columns are not read. Texts are shuffled once.
    """
    rows = keyed(docs, ["doc_id", "text"]).select("row_key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = materialize(neighbours(rows.select("row_key", "doc_id", F.char_length("text").alias("n_chars"))), "next")
    placed = rows.select("row_key", "text").join(order, "row_key")
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int")
    heads = placed.select(
        F.col("prev_key").alias("row_key"),
        F.substring("text", F.lit(1), quarter("prev_chars")).alias("head"),
        gram_set(chosen_grams(F.col("text"))).alias("next_grams"),
    )
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - quarter("n_chars")).cast("int"))
    both = placed.join(heads, "row_key").select(
        "doc_id", "n_chars", "next_grams", chosen_grams(F.col("text")).alias("own"), F.concat(kept, "head").alias("edited")
    )
    found = both.select(
        "doc_id",
        "n_chars",
        "own",
        "next_grams",
        F.sha2("edited", 256).alias("edited_sha256"),
        chosen_grams(F.col("edited")).alias("changed"),
    )
    return found.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("changed")).alias("edited_fingerprint"),
        likeness(gram_set(F.col("own")), gram_set(F.col("changed"))).alias("near_edited"),
        likeness(gram_set(F.col("own")), F.col("next_grams")).alias("near_next"),
    )
