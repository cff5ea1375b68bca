"""Event templates: loading, compiling to patterns, matching lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft import schemas
from logweft.functions import text as tx


# White space inside a template stands for any run of it, by Unicode's list.
_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
# The only letters beyond ASCII that case folding sends to an ASCII letter.
_FOLD_FROM, _FOLD_TO = "ſİıK", "siik"


@dataclass(frozen=True)
class Template:
    """``pattern`` ignores case and decides for any text. ``folded_pattern``
    decides the same on a case-folded line, much faster; it is empty for a
    template with letters beyond ASCII. ``probe`` is the longest
    white-space-free literal in lower case, which any match contains."""

    event_id: str
    text: str
    pattern: str
    folded_pattern: str
    probe: str


def compile_template(event_id: str, template: str, elastic: bool = True) -> Template:
    """Literal text with wildcards to a Java pattern for an unanchored search.

    Wildcards at either end are dropped: they never change whether the pattern
    is found, and make each failing search quadratic.
    """
    text = template.strip().replace("[*]", "<*>")
    literals = text.split("<*>")
    pattern = ".*?".join(re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", piece) for piece in literals)
    while pattern.startswith(".*?"):
        pattern = pattern[3:]
    while pattern.endswith(".*?"):
        pattern = pattern[:-3]
    low = pattern.lower()
    if elastic:
        pattern, low = pattern.replace(" ", _SPACE), low.replace(" ", _SPACE)
    words = [word for piece in literals for word in piece.split()]
    probe = max(words, key=len, default="").lower()
    folded = f"(?s){low}" if text.isascii() else ""
    return Template(event_id.strip(), text, f"(?isU){pattern}", folded, probe)


def vocabulary(rows: list[tuple[str, str]], elastic: bool = True) -> list[Template]:
    return [compile_template(event_id, template, elastic) for event_id, template in rows]


def load_templates(spark: SparkSession, path: str, elastic: bool = True) -> list[Template]:
    """Template file in its own order, which is the matching priority. The list is for
    vocabularies that a plan can spell out, some hundred; ``vocabulary.load_vocabulary``
    keeps any number as a table."""
    rows = spark.read.schema(schemas.TEMPLATES_CSV).csv(path, header=True, quote='"', escape='"')
    found = rows.collect()
    return vocabulary([(row.EventId, row.EventTemplate) for row in found], elastic)


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = [(i, t.event_id, t.text, t.pattern) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "ord int, event_id string, template string, pattern string")


def text_of(templates: list[Template], event_id: Column) -> Column:
    """Template text of an event id, null when unknown. The last of equal ids counts."""
    texts = {t.event_id: t.text for t in templates}
    entries = [F.lit(item) for pair in texts.items() for item in pair]
    return F.element_at(F.create_map(*entries), event_id)


def id_of(templates: list[Template], ord: Column) -> Column:
    """Event id at a matched ordinal."""
    return F.get(F.array(*[F.lit(t.event_id) for t in templates]), ord)


def folded_line(value: Column) -> Column:
    """Lower case in which each letter that may stand for an ASCII one is that one."""
    wide = F.octet_length(value) != F.char_length(value)
    return F.lower(F.when(wide, F.translate(value, _FOLD_FROM, _FOLD_TO)).otherwise(value))


def with_match(lines: DataFrame, templates: list[Template], when: Column, line: str = "value") -> DataFrame:
    """Add ``ord``: position of the first template found in the line, else null.

    The case-folded line is searched, and a pattern runs only if its probe word
    occurs. The one-element ``explode`` keeps the optimizer from copying the
    chain into every filter and expression that reads ``ord``.
    """
    value, folded = F.col(line), F.col("_folded")

    def found(t: Template) -> Column:
        if not t.folded_pattern:
            return value.rlike(t.pattern)
        return F.contains(folded, F.lit(t.probe)) & folded.rlike(t.folded_pattern)

    chain = [F.when(found(t), F.lit(i)) for i, t in enumerate(templates)]
    first = F.when(when, F.coalesce(*chain, F.lit(None).cast("int")))
    return lines.withColumn("_folded", folded_line(value)).select("*", F.explode(F.array(first)).alias("ord")).drop("_folded")


def match_event(line: Column, templates: list[Template]) -> Column:
    """The first template's id as one expression, for single columns."""
    return F.coalesce(
        *[F.when(line.rlike(t.pattern), F.lit(t.event_id)) for t in templates], F.lit(None).cast("string")
    )


def cleaned(templates_df: DataFrame) -> DataFrame:
    """Raw template rows with ids and texts trimmed and wildcards unified."""
    return templates_df.select(
        tx.strip("EventId").alias("event_id"),
        F.replace(tx.strip("EventTemplate"), F.lit("[*]"), F.lit("<*>")).alias("template"),
    )
