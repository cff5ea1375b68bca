"""Column expressions on one event sequence (an array of event ids)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logweft import fixed_values as fv


def positions(events: Column, event: str) -> Column:
    """0-based places of one event."""
    at = F.transform(events, lambda e, i: F.when(e == event, i))
    return F.filter(at, lambda i: i.isNotNull())


def position_map(events: Column, known: list[str]) -> Column:
    """Known events that occur, each with all its places."""
    pairs = F.transform(
        F.array_intersect(F.array(*[F.lit(e) for e in known]), events),
        lambda k: F.struct(
            k.alias("key"),
            F.filter(F.transform(events, lambda e, i: F.when(e == k, i)), lambda i: i.isNotNull()).alias("value"),
        ),
    )
    return F.map_from_entries(pairs)


def count_of(events: Column, event: str) -> Column:
    return F.size(F.filter(events, lambda e: e == event))


def pair_flags(events: Column, first: str, second: str) -> Column:
    """For each place, whether ``first`` stands there and ``second`` right after.
    Safe for empty and one-element arrays."""
    return F.transform(events, lambda e, i: (e == first) & F.coalesce(F.get(events, i + 1) == second, F.lit(False)))


def pair_count(events: Column, first: str, second: str) -> Column:
    """Adjacent pairs; for two different events no two pairs overlap."""
    return F.size(F.filter(pair_flags(events, first, second), lambda hit: hit))


def members(events: Column, wanted: list[str]) -> Column:
    """(pos, event) of every event in a class, in order."""
    placed = F.transform(events, lambda e, i: F.struct(i.alias("pos"), e.alias("event")))
    return F.filter(placed, lambda p: p["event"].isin(wanted))


def max_gap_before(events: Column, gaps: Column, wanted: list[str]) -> Column:
    """Largest gap in front of an event of a class, where a gap is known."""
    at = F.transform(events, lambda e, i: F.when(e.isin(wanted), F.get(gaps, i)))
    return F.array_max(at)


def insight(length: Column, n_gaps: Column, cleanup_gap: Column, max_gap: Column, latency: Column) -> Column:
    """Which timing remark applies, or null. Total time outranks single gaps."""
    has_gaps = n_gaps > 1
    return (
        F.when(latency < 5, "very_short")
        .when((latency > 3600) & (length >= 4), "very_long")
        .when(has_gaps & (cleanup_gap > 60), "long_gap_before_cleanup")
        .when(has_gaps & (max_gap > 120), "long_gap")
        .when(has_gaps & (max_gap > 30), "moderate_gap")
    )


SHOWN = 3


def features(events: Column, gaps: Column, latency: Column) -> dict[str, Column]:
    """Named facts about a sequence, as columns to select in one pass. Signal
    lists hold the first few; their full counts stand beside them."""
    failures = members(events, fv.FAILURE_EVENTS)
    context = members(events, fv.CONTEXT_EVENTS)
    first = F.get(failures, 0)["pos"]
    before = F.filter(F.slice(events, 1, F.coalesce(first, F.lit(0))), lambda e: e.isin(fv.NORMAL_BEFORE_FAILURE))
    place = lambda event: F.nullif(F.array_position(events, event), F.lit(0)) - 1
    return {
        "length": F.size(events),
        "n_failures": F.size(failures),
        "failures": F.slice(failures, 1, SHOWN),
        "n_context": F.size(context),
        "context": F.slice(context, 1, SHOWN),
        "norm_cycles": pair_count(events, "E11", "E9"),
        "imm_inval": F.exists(pair_flags(events, "E26", "E23"), lambda hit: hit),
        "alloc_no_reg": F.array_contains(events, "E22") & ~F.array_contains(events, "E26"),
        "serve_count": count_of(events, "E3"),
        "lookup_misses": count_of(events, "E20"),
        "first_fail_pos": first,
        "last_fail_pos": F.get(failures, F.size(failures) - 1)["pos"],
        "pre_fail_normal": F.size(before),
        "first_allocation": place("E22"),
        "first_registration": place("E26"),
        "time_insight": insight(
            F.size(events), F.size(gaps), max_gap_before(events, gaps, fv.CLEANUP_EVENTS), F.array_max(gaps), latency
        ),
    }


def distinct_in_order(events: Column) -> Column:
    return F.array_distinct(events)


def repeated(events: Column) -> Column:
    """(event, n) for events seen more than once: most frequent first, ties by
    first appearance."""
    counted = F.transform(
        F.array_distinct(events),
        lambda e, i: F.struct(
            (-F.size(F.filter(events, lambda other: other == e))).alias("less"), i.alias("seen"), e.alias("event")
        ),
    )
    often = F.array_sort(F.filter(counted, lambda c: c["less"] < -1))
    return F.transform(often, lambda c: F.struct(c["event"].alias("event"), (-c["less"]).alias("n")))


def length_between(events: Column, low: int = fv.MIN_SEQUENCE, high: int = fv.MAX_SEQUENCE) -> Column:
    return F.size(events).between(low, high)


def fingerprint(events: Column) -> Column:
    return F.md5(F.array_join(events, ","))
