"""Prompts and chat records as text and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logweft import fixed_values as fv
from logweft.functions import sequences as sq, text as tx
from logweft.operators.templates import Template


def glossary(events: Column, templates: list[Template]) -> Column:
    """Known distinct events with their texts, one per line, in order."""
    texts = {t.event_id: t.text for t in templates}
    lookup = F.create_map(*[F.lit(item) for pair in texts.items() for item in pair])
    known = F.filter(sq.distinct_in_order(events), lambda e: e.isin(list(texts)))
    return F.array_join(F.transform(known, lambda e: F.concat(F.lit("  "), e, F.lit(": "), F.element_at(lookup, e))), "\n")


def repeats_note(events: Column) -> Column:
    items = F.transform(
        sq.repeated(events), lambda r: F.concat(r["event"], F.lit(" appears "), r["n"].cast("string"), F.lit("x"))
    )
    return F.when(F.size(items) > 0, F.concat(F.lit("\nRepeated events: "), F.array_join(items, ", "))).otherwise("")


def generator_prompt(
    block_id: Column, events: Column, templates: list[Template], anomaly_type: Column, latency: Column
) -> Column:
    return tx.fill(
        fv.GENERATOR_PROMPT,
        glossary=glossary(events, templates),
        block_id=block_id,
        anomaly_type=anomaly_type,
        latency=tx.latency_text(latency),
        sequence=F.array_join(events, " -> "),
        repeats=repeats_note(events),
    )


def explainer_prompt(events: Column, latency: Column) -> Column:
    return tx.fill(fv.EXPLAINER_PROMPT, sequence=tx.python_list(events), latency=latency)


def verdict_prompt(block_id: Column, texts: Column, events: Column, latency: Column) -> Column:
    return tx.fill(
        fv.VERDICT_PROMPT,
        block_id=block_id,
        texts=tx.python_list(texts),
        events=tx.python_list(events),
        latency=latency,
    )


def user_message(block_id: Column, anomaly_type: Column, sequence: Column, length: Column, latency: Column) -> Column:
    """Facts of a block, one per line. A null ``latency`` leaves its line out."""
    lines = tx.fill(
        "Block: {b}\nAnomaly Type: {t}\nSequence: {s}\nSequence Length: {n}",
        b=block_id,
        t=anomaly_type,
        s=sequence,
        n=length,
    )
    return F.concat(lines, F.coalesce(F.concat(F.lit("\nLatency: "), latency), F.lit("")))


def text_list_length(sequence: Column) -> Column:
    """Length of a list kept as text: its commas plus one."""
    return F.char_length(sequence) - F.char_length(F.replace(sequence, F.lit(","), F.lit(""))) + 1


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: str, user: Column, assistant: Column | None = None) -> Column:
    parts = [message("system", F.lit(system)), message("user", user)]
    if assistant is not None:
        parts.append(message("assistant", assistant))
    return F.array(*parts)


def sampled_chat(answer: Column) -> Column:
    """Record of the sampling path, from block_id, anomaly_type, sequence, latency."""
    events = F.col("sequence")
    user = user_message(
        F.col("block_id"),
        F.col("anomaly_type"),
        tx.python_list(events),
        F.size(events),
        tx.latency_text(F.col("latency")),
    )
    return chat(fv.SYSTEM_PROMPT_SAMPLED, user, answer)


def training_chat(explanation: Column, latency: Column | None = None) -> Column:
    """Record of the training file; the latency line is optional."""
    events = F.col("sequence")
    listed = F.concat(F.lit("["), F.array_join(events, ", "), F.lit("]"))
    spent = F.lit(None).cast("string") if latency is None else F.concat(latency.cast("string"), F.lit("s"))
    user = user_message(F.col("block_id"), F.col("anomaly_type"), listed, F.size(events), spent)
    return chat(fv.SYSTEM_PROMPT_TRAINING, user, explanation)


def after_marker(output: Column, marker: str = fv.EXPLANATION_MARKER) -> Column:
    """Text after the last marker, trimmed. Works on the whole text."""
    return tx.strip(F.substring_index(output, marker, -1))
