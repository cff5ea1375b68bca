"""Sessions as keyed state: open events, closed by event-time timers.

A key is a bucket of blocks: a call of the keyed step costs some 10 ms whatever it is
given, so with a call for each block a batch took as long as it had blocks. The state of a
bucket is the events of its blocks that belong to no closed session yet, and one timer for
the earliest time at which one of their sessions can close. A closed session leaves the
stream with its ordered events, so nothing is looked up or joined afterwards. State is as
large as what is open: a session's events go when it closes. It comes to a bucket and goes
back in one piece with the bucket's new rows. A processor that calls the store for each
read, write and timer took half as long again over 100 000 lines, next to the same tail.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = ["at", "file_key", "block_start", "line_id", "ord"]
STATE = "block_id array<string>, at array<bigint>, file_key array<string>, block_start array<bigint>, line_id array<bigint>, ord array<int>"
CLOSED = "block_id string, first_at bigint, last_at bigint, n_events bigint, ords array<int>, gaps array<double>"
BUCKETS = 512  # of blocks; part of a checkpoint's meaning
END_OF_INPUT = "2262-01-01 00:00:00"  # near the last time that pandas can hold


def cut_sessions(events: list[tuple], gap: int) -> list[list[tuple]]:
    """Events in order of time and source position, parted where a pause reaches ``gap``."""
    out: list[list[tuple]] = []
    for event in sorted(events):
        if out and event[0] - out[-1][-1][0] < gap:
            out[-1].append(event)
        else:
            out.append([event])
    return out


def pauses(session: list[tuple]) -> list[float]:
    """Whole seconds since the event before, 0.0 for the first."""
    seconds = [event[0] // 1000 for event in session]
    return [0.0, *(float(b - a) for a, b in zip(seconds, seconds[1:]))]


def _closing(gap: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """``gap`` in milliseconds. A session closes once the watermark is a gap past its end:
    events that would continue it are late by then and dropped by Spark."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks: dict[str, list[tuple]] = defaultdict(list)
        held = [zip(*state.get)] if state.exists else []
        new = (zip(*(part[c].tolist() for c in ["block_id", *EVENT])) for part in rows)
        for part in chain(held, new):
            for block, *event in part:
                blocks[block].append(tuple(event))
        blocks.pop(None, None)  # rows without a block only move the watermark
        watermark = state.getCurrentWatermarkMs()
        closed, still_open, closing = [], [], []
        for block, events in blocks.items():
            for s in cut_sessions(events, gap):
                if s[-1][0] + gap <= watermark:
                    closed.append((block, s[0][0], s[-1][0], len(s), [e[4] for e in s], pauses(s)))
                else:
                    still_open += [(block, *event) for event in s]
                    closing.append(s[-1][0] + gap)
        if still_open:
            state.update(tuple(map(list, zip(*still_open))))
            state.setTimeoutTimestamp(min(closing))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=[c.split()[0] for c in CLOSED.split(", ")])

    return step


def gap_sessions(
    occurrences: DataFrame, gap_seconds: int, delay: str = "10 minutes", marks: DataFrame | None = None
) -> DataFrame:
    """Closed sessions of a stream: ``block_id``, ``first_ts``, ``last_ts``, ``n_events``,
    ``latency``, ``ords``, the template numbers in order of time and source position, and
    ``gaps``, the seconds before each.

    Events without a time cannot be placed on a stream and are left out; rows more than
    ``delay`` behind are dropped and counted by Spark. ``marks`` (see :func:`mark_stream`)
    closes what is open at the end of the input. ``live.drain``, ``live.start`` and
    ``live.caught_up`` set the RocksDB store.
    """
    timed = occurrences.filter("ts IS NOT NULL").select(
        "block_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("file_key").cast("string").alias("file_key"),
        F.col("block_start").cast("bigint").alias("block_start"),
        F.col("line_id").cast("bigint").alias("line_id"),
        F.col("ord").cast("int").alias("ord"),
    )
    if marks is not None:
        timed = timed.unionByName(marks, allowMissingColumns=True)
    bucket = F.when(F.col("block_id").isNotNull(), F.pmod(F.xxhash64("block_id"), F.lit(BUCKETS)))
    placed = timed.withWatermark("ts", delay).withColumns({"at": F.unix_millis("ts"), "bucket": bucket})
    closed = placed.groupBy("bucket").applyInPandasWithState(
        _closing(gap_seconds * 1000), CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return closed.select(
        "block_id",
        F.timestamp_millis("first_at").alias("first_ts"),
        F.timestamp_millis("last_at").alias("last_ts"),
        "n_events",
        (F.floor(F.col("last_at") / 1000) - F.floor(F.col("first_at") / 1000)).cast("double").alias("latency"),
        "ords",
        "gaps",
    )


MARK = "ts timestamp"


def mark_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Time marks of a folder as a stream: rows that only move the watermark."""
    spark.createDataFrame([], MARK).write.mode("append").parquet(folder)
    return spark.readStream.schema(MARK).parquet(folder)


def request_flush(spark: SparkSession, folder: str, until: str = END_OF_INPUT) -> None:
    """Ask a stream over :func:`mark_stream` to close all that began before ``until``.
    After the default, rows of ordinary times are late: it ends the input."""
    row = spark.range(1).select(F.lit(until).cast("timestamp").alias("ts"))
    row.write.mode("append").parquet(folder)
