"""Packing of tokenized documents into windows with minimum bin slack.

A document's ids fill whole windows first; what is left of it, shorter than a window, is a
tail. Tails are packed by their lengths. The longest one left opens a window, and a subset
sum over the multiset of the other lengths finds the fill nearest to the capacity: bit ``v``
of a number says that ``v`` tokens can be reached, lengths enter in descending order as
shifts by 1, 2, 4, ... copies, and the numbers before each shift lead back to how many of
each length were taken. The fill is repeated as often as the counts allow. Where no subset
fills a window, one more tail is cut to fill it. So every window is full but the last tokens
of a task, which are cut into windows of powers of two: these need no padding.

A task packs its own rows, in blocks of bounded size that hand their last tokens on, so
nothing is shuffled or stored, a source or text of any share is spread like the rows are,
and a task that runs again gives the same windows.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from logweft.llm.common import text_bytes

WINDOW = 1024
BLOCK_TOKENS = 8 << 20  # of tails and whole windows that a task holds before it packs them
OUT_TOKENS = 1 << 20  # of one batch that a task passes on
SEQUENCE_BITS = 40  # a task's number stands above so many bits of its own count


# -- ids ---------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as a tokenizers file gives them, special strings being plain text.

    A byte-level file whose merges make ids in ascending order is a table of ranks, so the
    faster library reads it with the same ids (tested on all code points and whole texts).
    Any other file, and any text on which that library gives up, goes through tokenizers.
    """

    def __init__(self, content: str):
        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.encode_special_tokens = True
        self._ranked = self._as_ranks(json.loads(content))

    @staticmethod
    def _as_ranks(file: dict) -> tiktoken.Encoding | None:
        model, before = file["model"], file.get("pre_tokenizer") or {}
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "fuse_unk",
                                      "continuing_subword_prefix", "end_of_word_suffix")]
        if model["type"] != "BPE" or file.get("normalizer") or any(odd) or any(before.get(k) != v for k, v in wanted.items()):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get("".join(pair)) for pair in pairs]
        if len(model["vocab"]) != 256 + len(pairs) or made != list(range(256, 256 + len(pairs))):
            return None
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._ranked is not None:
            try:
                return self._ranked.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern gives up on very long white space
                pass
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


# -- windows -----------------------------------------------------------------


def fullest(counts: Counter, room: int) -> dict[int, int]:
    """The multiset of ``counts`` (length to number) with the greatest sum up to ``room``."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            layers.append((length, copies, reach))
            reach |= reach << copies * length & mask
            left, copies = left - copies, copies * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(layers):
        if not before >> at & 1:
            at -= copies * length
            taken[length] = taken.get(length, 0) + copies
    return taken


def packed(pieces: list[tuple], window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Full windows of pieces (document, start, length), each shorter than ``window``, and
    the pieces that are left, together shorter than a window."""
    held: dict[int, list[tuple]] = defaultdict(list)
    for piece in reversed(pieces):
        held[piece[2]].append(piece)
    counts = Counter({length: len(of) for length, of in held.items()})
    total, windows = sum(length * n for length, n in counts.items()), []
    while total >= window:
        longest = max(counts)
        others = counts.copy()
        others[longest] -= 1
        if not others[longest]:
            del others[longest]
        taken = fullest(others, window - longest)
        taken[longest] = taken.get(longest, 0) + 1
        slack = window - sum(length * n for length, n in taken.items())
        repeats = 1 if slack else min(counts[length] // n for length, n in taken.items())
        for _ in range(repeats):
            filled = [held[length].pop() for length, n in taken.items() for _ in range(n)]
            if slack:
                doc, start, length = held[max(x for x in held if held[x])].pop()  # all left are longer than the slack
                filled.append((doc, start, slack))
                held[length - slack].append((doc, start + slack, length - slack))
                taken |= {length: 0, length - slack: 0}
            for length in taken:
                counts[length] = len(held[length])
                if not counts[length]:
                    del counts[length], held[length]
            windows.append(filled)
            total -= window
    return windows, [piece for length in sorted(counts, reverse=True) for piece in held[length]]


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces in windows whose lengths are the powers of two that make up their sum."""
    total, windows, waiting = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room, filled = total & 1 << bit, []
        while room:
            doc, start, length = waiting.pop()
            taken = min(room, length)
            filled.append((doc, start, taken))
            if taken < length:
                waiting.append((doc, start + taken, length - taken))
            room -= taken
        if filled:
            windows.append(filled)
    return windows


class _Packer:
    """Blocks of one task: documents come in, lists of (document, start, length) go out."""

    def __init__(self, window: int):
        self.window, self.documents, self.windows, self.tails, self.size = window, {}, [], [], 0
        self._next = 0  # documents are (id, first of the ids held, ids held, number of all ids)

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        doc, whole = self._next, len(ids) - len(ids) % self.window
        self._next += 1
        self.documents[doc] = (doc_id, 0, ids, len(ids))
        self.windows += [[(doc, start, self.window)] for start in range(0, whole, self.window)]
        if whole < len(ids):
            self.tails.append((doc, whole, len(ids) - whole))
        self.size += len(ids)

    def passed_on(self, last: bool) -> Iterator[list[tuple]]:
        filled, self.tails = packed(self.tails, self.window)
        yield from self.windows
        yield from filled
        if last:
            yield from powers(self.tails)
            self.tails = []
        held, self.documents = self.documents, {}
        for doc, start, _ in self.tails:  # of a document that was cut, only one part is left
            doc_id, first, ids, size = held[doc]
            self.documents[doc] = (doc_id, start, ids[start - first :].copy(), size)
        self.windows, self.size = [], 0


def _windows(batches: Iterator[pa.RecordBatch], content: str, end_id: int, window: int) -> Iterator[tuple]:
    """(number in the task, [(doc_id, start, ids, ids of the document)]) of one task's rows."""
    encoder, packer, number = _encoder(content), _Packer(window), 0

    def named(last: bool) -> Iterator[tuple]:
        nonlocal number
        documents = packer.documents
        for filled in packer.passed_on(last):
            parts = [(*documents[doc], start, length) for doc, start, length in filled]
            yield number, [(name, s, ids[s - first : s - first + n], size) for name, first, ids, size, s, n in parts]
            number += 1

    for batch in batches:
        names = batch.column(0)
        for i, text in enumerate(batch.column(1)):
            ids = encoder.ids(text.as_py().decode("utf-8", "replace"))
            packer.add(names[i], np.append(ids, np.uint32(end_id)))
            if packer.size >= BLOCK_TOKENS:
                yield from named(False)
    yield from named(True)


def _id_lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int32)))


def _in_windows(docs: DataFrame, tokenizer: str, end_id: int, window: int, batch_of, schema: str) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, size = TaskContext.get().partitionId() << SEQUENCE_BITS, [], 0
        for number, pieces in _windows(batches, content.value, end_id, window):
            rows.append((base + number, pieces))
            size += sum(len(p[2]) for p in pieces)
            if size >= OUT_TOKENS:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(step, schema)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers), ``doc_tokens``, ``sequence_id`` and ``offset``.

    Every whole text (null: empty) is encoded and ends with ``end_id``, so each row of the
    documents has at least one piece; repeated rows and ids are packed each on their own.
    Equal lengths are taken in the order of the rows. Sequence ids are unique and no more:
    they and the windows follow from how the rows are dealt to tasks. Only ``doc_id`` (of
    any type, null allowed) and ``text`` are read; other columns can have any name.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def batch_of(rows: list) -> pa.RecordBatch:
        flat = [(sequence, at, piece) for sequence, filled in rows for at, piece in enumerate(filled)]
        ends = [np.cumsum([0, *(len(p[2]) for p in filled)])[:-1] for _, filled in rows]
        names = [piece[0] for _, _, piece in flat]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([n.as_py() for n in names], names[0].type),
                pa.array([p[1] for _, _, p in flat], pa.int64()),
                pa.array([len(p[2]) for _, _, p in flat], pa.int64()),
                _id_lists([p[2] for _, _, p in flat]),
                pa.array([zlib.crc32(p[2].astype("<u4", copy=False).tobytes()) for _, _, p in flat], pa.int64()),
                pa.array([p[3] for _, _, p in flat], pa.int64()),
                pa.array([sequence for sequence, _, _ in flat], pa.int64()),
                pa.array(np.concatenate(ends), pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    schema = (
        f"doc_id {id_type}, start bigint, length bigint, ids array<int>, ids_crc32 bigint, "
        "doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return _in_windows(docs, tokenizer, end_id, window, batch_of, schema)


def sequences(docs: DataFrame, tokenizer: str, end_id: int, pad_id: int, window: int = WINDOW) -> DataFrame:
    """The windows as a trainer reads them: ``sequence_id``, ``ids`` (padded to ``window``
    unless their number is a power of two), ``n_tokens`` before padding and ``starts``,
    where each piece begins. Rows, ids and null texts as in ``pieces``."""

    def batch_of(rows: list) -> pa.RecordBatch:
        filled, counts, starts = [], [], []
        for _, parts in rows:
            size = sum(len(p[2]) for p in parts)
            short = 0 if size & (size - 1) == 0 else window - size
            filled.append(np.concatenate([*(p[2] for p in parts), np.full(short, pad_id, np.uint32)]))
            counts.append(size)
            starts.append(np.cumsum([0, *(len(p[2]) for p in parts)])[:-1].astype(np.uint32))
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in rows], pa.int64()), _id_lists(filled), pa.array(counts, pa.int64()), _id_lists(starts)],
            names=["sequence_id", "ids", "n_tokens", "starts"],
        )

    schema = "sequence_id bigint, ids array<int>, n_tokens bigint, starts array<int>"
    return _in_windows(docs, tokenizer, end_id, window, batch_of, schema)


def digests(of: DataFrame) -> DataFrame:
    """``pieces`` without their ids."""
    return of.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
