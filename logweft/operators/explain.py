"""Rule-based explanations: facts of a sequence put into fixed sentence forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logweft import fixed_values as fv
from logweft.functions import sequences as sq, text as tx
from logweft.operators.ranking import rank_rows

ROTATIONS = len(fv.OPENINGS_PLAIN)


def _phrases() -> Column:
    return F.create_map(*[F.lit(item) for pair in fv.EVENT_PHRASES.items() for item in pair])


def _listed(found: Column, count: Column, more: tuple[str, str]) -> Column:
    """The first signals, and how many are left."""
    extra = count - sq.SHOWN
    shown = F.transform(
        found,
        lambda s: tx.fill(fv.SIGNAL_AT, phrase=F.element_at(_phrases(), s["event"]), pos=s["pos"]),
    )
    rest = (
        F.when(extra == 1, F.array(tx.fill(more[0], n=extra)))
        .when(extra > 1, F.array(tx.fill(more[1], n=extra)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_join(F.concat(shown, rest), "; ")


def signal_text() -> Column:
    """What gives the anomaly away: failures, else context signals, else shape."""
    return (
        F.when(F.col("n_failures") > 0, _listed(F.col("failures"), F.col("n_failures"), fv.MORE_FAILURES))
        .when(F.col("n_context") > 0, _listed(F.col("context"), F.col("n_context"), fv.MORE_CONTEXT))
        .when(F.col("alloc_no_reg"), fv.NO_REGISTRATION)
        .when(F.col("imm_inval"), fv.INVALIDATED)
        .otherwise(fv.ODD_ORDER)
    )


def normal_text() -> Column:
    """Normal activity worth a mention; empty when there is none."""
    cycles = F.when(F.col("norm_cycles") > 0, tx.fill(fv.NORMAL_CYCLES, n=F.col("norm_cycles")))
    serves = F.when(F.col("serve_count") >= 5, tx.fill(fv.NORMAL_SERVES, n=F.col("serve_count")))
    return F.concat_ws(" and ", cycles, serves)


def detail_text() -> Column:
    """One further fact, or null. The first rule that applies decides, even when
    it has nothing to say (failures side by side)."""
    c = F.col
    span = F.when(
        c("last_fail_pos") > c("first_fail_pos") + 1,
        tx.fill(fv.DETAIL_SPAN, a=c("first_fail_pos"), b=c("last_fail_pos"), n=c("length")),
    )
    return (
        F.when(c("lookup_misses") >= 2, tx.fill(fv.DETAIL_LOOKUP_MISSES, n=c("lookup_misses")))
        .when(
            c("imm_inval"),
            tx.fill(fv.DETAIL_ROLLBACK, a=c("first_registration"), b=c("first_registration") + 1),
        )
        .when(c("alloc_no_reg"), tx.fill(fv.DETAIL_NOT_COMPLETED, a=c("first_allocation")))
        .when(c("n_failures") >= 2, span)
        .when(
            (c("norm_cycles") == 0) & (c("pre_fail_normal") == 0) & (c("length") <= 3),
            tx.fill(fv.DETAIL_SHORT, n=c("length")),
        )
    )


def time_text(latency: Column) -> Column:
    form = lambda kind: tx.fill(fv.TIME_TEXTS[kind], latency=latency, seconds=latency.cast("bigint"))
    return reduce(
        lambda chain, kind: chain.when(F.col("time_insight") == kind, form(kind)),
        list(fv.TIME_TEXTS)[1:],
        F.when(F.col("time_insight") == "very_short", form("very_short")),
    )


def sentence_capital(text: Column) -> Column:
    """First letter raised, the rest lowered."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def _lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def _opening(forms: list[str], slots: dict[str, Column]) -> Column:
    return F.get(F.array(*[tx.fill(form, **slots) for form in forms]), F.col("rotation"))


def at_most_five(text: Column) -> Column:
    pieces = tx.sentences(text)
    return F.when(
        F.size(pieces) > 5, F.concat(F.array_join(F.slice(pieces, 1, 5), ". "), F.lit("."))
    ).otherwise(text)


def sentence_count(text: Column) -> Column:
    return F.size(tx.sentences(text))


def rotation(
    rows: DataFrame, cells: Sequence[Column], order: Sequence[str | Column], store: bool = False
) -> DataFrame:
    """Add ``rotation``: how often the same (type, sequence) came before, modulo 5.

    Equal short sequences are common, so a group may hold a large share of all
    rows; the ranking never puts a whole group into one task.
    """
    keyed = rows.withColumn("fingerprint", sq.fingerprint(F.col("sequence")))
    ranked = rank_rows(keyed, "_nth", cells, order, ["anomaly_type", "fingerprint"], store)
    return ranked.withColumn("rotation", (F.col("_nth") % ROTATIONS).cast("int")).drop("_nth")


def sequence_features(rows: DataFrame) -> DataFrame:
    facts = sq.features(F.col("sequence"), F.col("time_interval"), F.col("latency"))
    return rows.withColumns(facts)


def explanations(
    traces: DataFrame,
    types: DataFrame,
    cells: Sequence[Column],
    order: Sequence[str | Column],
    store: bool = False,
) -> DataFrame:
    """One explanation per valid trace. ``types`` is the small type dimension;
    ``store`` suits traces that are costly to derive, as they are read twice."""
    numbered = sequence_features(rotation(traces, cells, order, store))
    told = numbered.join(F.broadcast(types), "anomaly_type").withColumns(
        {"_signals": signal_text(), "_normal": normal_text(), "_detail": detail_text()}
    )
    slots = {
        "signals": F.col("_signals"),
        "normal": F.col("_normal"),
        "cause": F.col("cause"),
        "impact": F.col("impact"),
        "impact_lower": F.regexp_replace(_lower_first(F.col("impact")), r"\.$", ""),
    }
    opening = F.when(F.col("_normal") != "", _opening(fv.OPENINGS_WITH_NORMAL, slots)).otherwise(
        _opening(fv.OPENINGS_PLAIN, slots)
    )
    detail = F.concat(sentence_capital(F.col("_detail")), F.lit("."))
    text = tx.squeeze_spaces(F.concat_ws(" ", opening, detail, time_text(F.col("latency"))))
    kept = [c for c in traces.columns if c not in ("time_interval", "latency")]
    return told.withColumn("_text", text).select(
        *kept, "rotation", tx.squeeze_spaces(at_most_five(F.col("_text"))).alias("explanation")
    )


def rule_explanation(rows: DataFrame) -> DataFrame:
    """``explanation`` by rules alone for sequences without a known type: the signals,
    one further fact and the time. ``rows`` has sequence, gaps and latency."""
    told = rows.withColumns(sq.features(F.col("sequence"), F.col("gaps"), F.col("latency")))
    sentence = lambda text: F.concat(sentence_capital(text), F.lit("."))
    text = F.concat_ws(" ", sentence(signal_text()), sentence(detail_text()), time_text(F.col("latency")))
    return told.select(*rows.columns, tx.squeeze_spaces(text).alias("explanation"))
