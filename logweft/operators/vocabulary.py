"""Template search for vocabularies of any size, as an equi-join on rare literals.

A template's literal text between its wildcards has to stand in every line it is found in.
Words inside that text, with a delimiter on both sides, stand there as whole words; any
four characters of it stand there as a gram. Each template is listed under its rarest whole
word, or its rarest gram if it has no such word. Lines send their distinct words (and grams,
if any template needs them), an equi-join brings the few templates listed there, their
patterns decide, and the first template in file order is kept. Templates with neither are
few and short; they are tried on every line, as ``templates.with_match`` tries all.

Nothing is collected: the vocabulary is a table, and its compiled patterns and keys too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft import schemas
from logweft.functions import text as tx
from logweft.operators.ranking import SOURCE_ORDER, range_numbered
from logweft.operators.templates import compile_template, folded_line
from logweft.session import materialize
from logweft.sources.tables import positioned

GRAM = 4
POSITION = ["file_key", "block_start", "line_id"]
_COMPILED = (
    "ord bigint, event_id string, template string, pattern string, folded boolean, probe string, "
    "words array<string>, grams array<string>"
)
_WORD = re.compile("[a-z0-9]+")
_EDGE = re.compile(r"[\x00-\x7f]")


def literal_keys(text: str) -> tuple[list[str], list[str]]:
    """Whole words and grams that each line with this template has, in lower case.

    A word counts if ASCII delimiters of the same literal stand on both sides: at a
    wildcard, or at either end of an unanchored search, a line's word may go on. White
    space may match any run of it, so grams hold none.
    """
    words, grams = set(), set()
    for literal in text.lower().split("<*>"):
        for found in _WORD.finditer(literal):
            before, after = literal[found.start() - 1 : found.start()], literal[found.end() : found.end() + 1]
            if before and after and _EDGE.match(before) and _EDGE.match(after):
                words.add(found.group())
        for piece in literal.split():
            grams.update(g for i in range(len(piece) - GRAM + 1) if (g := piece[i : i + GRAM]).isascii())
    return sorted(words), sorted(grams)


def compiled(rows: DataFrame, elastic: bool = True) -> DataFrame:
    """``ord``, ``EventId`` and ``EventTemplate`` with patterns and keys, one row each."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ord, event_id, template in batch.itertuples(index=False):
                t = compile_template(event_id or "", template or "", elastic)
                words, grams = literal_keys(t.text)
                folded = bool(t.folded_pattern)
                out.append((ord, t.event_id, t.text, t.folded_pattern or t.pattern, folded, t.probe, words, grams))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COMPILED.split(", ")])

    return rows.select("ord", "EventId", "EventTemplate").mapInPandas(step, _COMPILED)


def load_vocabulary(spark: SparkSession, paths: str | list[str], elastic: bool = True) -> DataFrame:
    """Template files as one stored table. The order of lines in a file, and of the files'
    paths, is the matching priority; there is no limit to their number."""
    rows = positioned(spark.read.schema(schemas.TEMPLATES_CSV).csv(paths, header=True, quote='"', escape='"'))
    return materialize(compiled(range_numbered(rows, "ord", list(SOURCE_ORDER)), elastic), "vocabulary")


def template_index(vocabulary: DataFrame) -> DataFrame:
    """``key`` and the template listed under it, one row per template: ``w`` and its rarest
    word, ``g`` and its rarest gram, or null for a template that has neither."""
    some = F.when(F.size("words") > 0, F.transform("words", lambda w: F.concat(F.lit("w"), w))).otherwise(
        F.transform("grams", lambda g: F.concat(F.lit("g"), g))
    )
    keyed = vocabulary.select("ord", F.explode(some).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = keyed.join(counts, "key").groupBy("ord").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    return vocabulary.drop("words", "grams").join(rarest, "ord", "left")


def line_keys(folded: Column, with_grams: bool) -> Column:
    """Distinct words of a folded line, and its grams."""
    words = F.transform(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("w"), w))
    if not with_grams:
        return F.array_distinct(words)
    size = F.greatest(F.char_length(folded) - (GRAM - 1), F.lit(0))
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.concat(F.lit("g"), F.substring(folded, i, F.lit(GRAM))))
    return F.array_distinct(F.concat(words, grams))


def _verified(found: DataFrame) -> DataFrame:
    fits = F.when(
        F.col("folded"), F.contains("_folded", F.col("probe")) & F.expr("_folded RLIKE pattern")
    ).otherwise(F.expr("value RLIKE pattern"))
    return found.filter(fits)


def matches(lines: DataFrame, index: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Lines in which a template is found: their position, the columns of ``kept``, and
    ``ord`` and ``event_id`` of the first such template.

    ``lines`` has ``value`` and a unique position (``file_key``, ``block_start``,
    ``line_id``). The only shuffle of lines holds positions, ``kept`` and ordinals of
    those that matched; the index is broadcast if Spark finds it small.
    """
    kept = kept or []
    index = materialize(index, "template-index")
    listed = index.filter("key IS NOT NULL")
    with_grams = not listed.filter("key LIKE 'g%'").isEmpty()
    folded = lines.select(*POSITION, *kept, "value", folded_line(F.col("value")).alias("_folded"))
    sent = folded.withColumn("key", F.explode(line_keys(F.col("_folded"), with_grams)))
    hits = _verified(sent.join(listed, "key"))
    short = index.filter("key IS NULL").groupBy("pattern", "folded").agg(F.min(F.struct("ord", "event_id")).alias("first"))
    rest = short.select("pattern", "folded", "first.*").orderBy("ord").collect()
    columns = [*POSITION, *kept, F.col("ord"), F.col("event_id")]
    found = hits.select(*columns)
    if rest:  # literals shorter than a gram: as few as there are such texts
        tried = F.coalesce(*[
            F.when(F.col("_folded" if t.folded else "value").rlike(t.pattern),
                   F.struct(F.lit(t.ord).alias("ord"), F.lit(t.event_id).alias("event_id")))
            for t in rest
        ])
        chained = folded.withColumn("_first", F.explode(F.array(tried))).filter("_first IS NOT NULL")
        found = found.unionByName(chained.select(*POSITION, *kept, "_first.ord", "_first.event_id"))
    first = found.groupBy(*POSITION).agg(
        F.min(F.struct("ord", "event_id")).alias("_first"), *[F.any_value(c).alias(c) for c in kept]
    )
    return first.select(*POSITION, *kept, "_first.ord", "_first.event_id")


def events(lines: DataFrame, index: DataFrame) -> DataFrame:
    """As ``lines.events``, for a vocabulary of any size: matched lines with a block id as
    occurrences, with ``event_id`` beside ``ord``."""
    clean = lines.withColumn("value", tx.clean_line(F.col("value")))
    blocks = clean.withColumn("block_id", tx.block_id(F.col("value"))).filter("block_id IS NOT NULL")
    timed = blocks.withColumn("ts", tx.log_time(F.col("value")))
    return matches(timed, index, ["block_id", "ts"]).select("block_id", "ts", "ord", *POSITION, "event_id")
