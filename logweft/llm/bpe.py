"""Byte-level BPE as a transducer that is made deterministic while it reads.

Merges are compiled into a machine that reads bytes and emits tokens. What it has
to remember after a prefix is: the longest suffix that some token may still
continue, the last token of the encoding of every prefix that ends in that suffix,
and the tokens on the ways back from there that not all of these ways share. Such
a memory is a *state*; a state and a byte lead to one state and to the tokens that
have become certain, so output lags by less than the longest token. Transitions
are built the first time they are needed and then looked up. (A token may follow
another if encoding both their bytes gives just these two; exactly one token ending
at a position may follow the encoding before it.)

The cutting pattern never joins what stands on both sides of the start of a white-
space run, so each run of white space with the word after it is encoded for itself,
and frequent ones are remembered per worker in a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from logweft.llm.common import text_bytes, values

#: White space as the pattern's engine means it (Unicode White_Space). Fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"
MOST_STATES = 40_000  # transducer states that a worker builds
MOST_PAIRS = 300_000  # remembered pairs of tokens
MOST_WORDS = 300_000  # remembered words of a worker, in two generations
OUT_BYTES = 2 << 20  # text bytes per output batch
DECODED_IDS = 4096  # ids of a chunk of streamed decoding

Ranks = dict[bytes, int]
NO_RANK = 1 << 60


def parse_ranks(content: bytes) -> Ranks:
    """The ``.tiktoken`` form: a base64 token and its rank in every line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def token_list(ranks: Ranks) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def merge(piece: bytes, ranks: Ranks) -> list[bytes]:
    """Plain BPE of a short piece: join the adjacent pair of least rank, leftmost first."""
    return _merged(piece, ranks, -1) or []


def stay_apart(left: bytes, right: bytes, ranks: Ranks) -> bool:
    """Does plain BPE of both, one after the other, give just these two tokens?"""
    return _merged(left + right, ranks, len(left)) == [left, right]


def _merged(piece: bytes, ranks: Ranks, border: int) -> list[bytes] | None:
    """The parts that plain BPE ends with, or None once it joins across ``border``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    known = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while known:
        least = min(known)
        if least == NO_RANK:
            break
        i = known.index(least)
        if i < border:
            border -= 1
            if i == border:
                return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del known[i]
        if i:
            known[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(known):
            known[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return parts


class Suffix:
    """The longest suffix read so far that a token may still continue. ``steps[byte]``
    is (the next suffix, the tokens that may end there with their sizes, longest first,
    and the places, counted back from there, where later tokens may begin)."""

    __slots__ = ("read", "steps")

    def __init__(self, read: bytes):
        self.read = read
        self.steps: dict[int, tuple[Suffix, list[tuple[int, int]], list[int]]] = {}


START = -1  # stands for the token before a piece


class Transducer:
    """``_state[n]`` is (suffix, {place counted back from the end: last token there}).

    Places are those where a coming token may begin, and those on the ways back from
    them to the nearest place that all ways share, which is the greatest. The token
    at a place is START at the start of the piece. Once ``most`` states are built, an
    unknown transition is not made a state: the rest of that piece is read with the
    places themselves, which gives the same tokens more slowly.
    """

    def __init__(self, ranks: Ranks, most: int = MOST_STATES):
        self.ranks, self.most = ranks, most
        self._bytes = token_list(ranks)
        self._size = [len(token) for token in self._bytes]
        self._openings = {token[:n] for token in ranks for n in range(1, len(token))}
        self._follows: dict[int, bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._suffixes: dict[bytes, Suffix] = {b"": Suffix(b"")}
        self._number: dict[tuple, int] = {}
        self._state: list[tuple[Suffix, dict[int, int]]] = []
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._rest: dict[int, tuple[int, ...]] = {}
        self._intern(self._suffixes[b""], {0: START})

    def _intern(self, suffix: Suffix, places: dict[int, int]) -> int:
        key = (suffix.read, *places.items())
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._state)
            self._state.append((suffix, places))
        return number

    def _is_whole(self, token: bytes) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = merge(token, self.ranks) == [token]
        return known

    def _may_follow(self, before: int, token: int) -> bool:
        """May the token come after this one (START: after nothing)?"""
        if before == START:
            return True
        pair = before << 32 | token
        known = self._follows.get(pair)
        if known is None:
            if len(self._follows) > MOST_PAIRS:
                self._follows.clear()
            known = self._follows[pair] = stay_apart(self._bytes[before], self._bytes[token], self.ranks)
        return known

    def _step(self, suffix: Suffix, byte: int) -> tuple[Suffix, list[tuple[int, int]], list[int]]:
        found = suffix.steps.get(byte)
        if found is None:
            read = suffix.read + bytes([byte])
            ends = [read[i:] for i in range(len(read))]
            opens = [len(e) for e in ends if e in self._openings]
            kept = read[-opens[0] :] if opens else b""
            after = self._suffixes.setdefault(kept, Suffix(kept))
            tokens = [(self.ranks[e], len(e)) for e in ends if e in self.ranks and self._is_whole(e)]
            found = suffix.steps[byte] = (after, tokens, [0, *reversed(opens)])
        return found

    def _build(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, before = self._state[state]
        suffix, tokens, opens = self._step(suffix, byte)
        places = {place + 1: token for place, token in before.items()}
        # Exactly one of the tokens that may end here follows the encoding before it.
        places[0] = next(t for t, size in tokens if size in places and self._may_follow(places[size], t))
        live, kept = set(opens), {}
        while len(live) > 1:
            place = min(live)
            live.remove(place)
            kept[place] = places[place]
            live.add(place + self._size[places[place]])
        (trunk,) = live
        kept[trunk] = places[trunk]
        return self._intern(suffix, kept), self._between(places, trunk)

    def _between(self, places: dict[int, int], place: int) -> tuple[int, ...]:
        """The tokens from the first place kept up to this one."""
        first, out = max(places), []
        while place != first:
            out.append(places[place])
            place += self._size[places[place]]
        return tuple(reversed(out))

    def _finish(self, state: int) -> tuple[int, ...]:
        rest = self._rest.get(state)
        if rest is None:
            rest = self._rest[state] = self._between(self._state[state][1], 0)
        return rest

    def _read_on(self, state: int, rest: bytes) -> list[int]:
        """Tokens still to come, without new states; here places are counted forward."""
        suffix, places = self._state[state]
        first = -max(places)
        last = {-place: token for place, token in places.items()}
        follows, end = self._follows, 0
        for byte in rest:
            step = suffix.steps.get(byte) or self._step(suffix, byte)
            suffix = step[0]
            end += 1
            for token, size in step[1]:
                before = last.get(end - size)
                if before is None:
                    continue
                known = follows.get(before << 32 | token)
                if known or known is None and self._may_follow(before, token):
                    last[end] = token
                    break
        out, sizes = [], self._size
        while end != first:
            out.append(last[end])
            end -= sizes[last[end]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece of the cutting pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        state, known = 0, self._next
        for at, byte in enumerate(piece):
            step = known.get(state << 8 | byte)
            if step is None:
                if len(self._state) >= self.most:
                    return out + self._read_on(state, piece[at:])
                step = known[state << 8 | byte] = self._build(state, byte)
            state, certain = step
            if certain:
                out += certain
        out += self._finish(state)
        return out


class Encoder:
    """Cuts whole texts, encodes every match for itself and remembers frequent words."""

    def __init__(self, ranks: Ranks, pattern: str):
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self._pieces = regex.compile(own).findall
        self._words = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self._machine = Transducer(ranks)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            pieces = self._pieces(word)
            if len(pieces) == 1:
                ids = array("i", self._machine.encode(word.encode())).tobytes()
            else:  # a piece is often a word seen elsewhere
                young, old, encode = self._young, self._old, self._machine.encode
                parts = [
                    young.get(p) or old.get(p) or array("i", encode(p.encode())).tobytes() for p in pieces
                ]
                if len(pieces[0]) <= 64:
                    young[pieces[0]] = parts[0]
                ids = b"".join(parts)
        if len(word) <= 64:  # long junk comes back rarely
            if len(self._young) >= MOST_WORDS // 2:
                self._old, self._young = self._young, {}
            self._young[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        young, other = self._young, self._word
        parts = []
        for word in self._words(text):
            ids = young.get(word)
            if ids is None:
                ids = other(word)
                young = self._young
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)


class Utf8Stream:
    """Text from byte chunks that may cut characters: the state is the unfinished
    character's bytes. What can't become UTF-8 is replaced by U+FFFD."""

    def __init__(self) -> None:
        self._open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character but don't end it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if need > back and lead < 0xF8 else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self._open + chunk
        cut = len(data) - self._unfinished(data)
        self._open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._open = self._open, b""
        return rest.decode("utf-8", "replace")


def decode_bytes(ids: Iterable[int], tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def decode_stream(ids: list[int], tokens: list[bytes], step: int = 1) -> Iterator[str]:
    """Text as it comes, ``step`` ids at a time: what is given out never changes."""
    stream = Utf8Stream()
    for start in range(0, len(ids), step):
        if text := stream.feed(decode_bytes(ids[start : start + step], tokens)):
            yield text
    if text := stream.close():
        yield text


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(parse_ranks(content), pattern)


@lru_cache(maxsize=2)
def _tokens(content: bytes) -> tuple[list[bytes], list[bytes]]:
    tokens = token_list(parse_ranks(content))
    return tokens, [str(i).encode() for i in range(len(tokens))]


def encoded_batches(
    batches: Iterator[pa.RecordBatch], content: bytes, pattern: str, kept: list[str]
) -> Iterator[pa.RecordBatch]:
    """Batches with the kept columns and ``ids``, of bounded size."""
    encoder = _encoder(content, pattern)
    for batch in batches:
        texts = values(batch, "_text")
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= OUT_BYTES):
                size += len(texts[end])
                end += 1
            found = [encoder.encode(t.decode("utf-8", "replace")) for t in texts[start:end]]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            columns = [batch.column(i).slice(start, end - start) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, ids], names=[*kept, "ids"])
            start = end


def digested_batches(batches: Iterator[pa.RecordBatch], content: bytes, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts and digests of ids, and of the text decoded from them as a stream."""
    tokens, numbers = _tokens(content)
    for batch in batches:
        column = batch.column(len(kept))
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
        counts, of_ids, of_bytes = [], [], []
        for a, b in zip(offsets, offsets[1:]):
            ids = flat[a:b].tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(b",".join(map(numbers.__getitem__, ids))).hexdigest())
            decoded = hashlib.sha256()
            for text in decode_stream(ids, tokens, DECODED_IDS):
                decoded.update(text.encode())
            of_bytes.append(decoded.hexdigest())
        columns = [batch.column(i) for i in range(len(kept))]
        extra = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*columns, *extra], names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def _rows(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("_text"))
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema.fields)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of every whole text.

    ``path`` is the vocabulary's file, read once on the driver and broadcast: its
    size is that of the file. A null or empty text has no ids; other columns are
    not read, repeated rows are encoded each.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    rows, kinds = _rows(docs, keep)
    return rows.mapInArrow(lambda it: encoded_batches(it, content.value, pattern, keep), f"{kinds}, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns and ``text``, decoded from ``ids`` (null: empty)."""
    content = encoded.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    rows = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("ids").schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = _tokens(content.value)
        for batch in batches:
            texts = ["".join(decode_stream(ids, tokens)) for ids in values(batch, "ids")]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(step, f"{kinds}, text string")


def encode_checked(docs: DataFrame, path: str, pattern: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids``, and whether decoding gives the text's bytes again.

    Null and empty texts have no ids and are round trips; repeated rows are encoded alike
    and there are no ties; columns of any name can be kept, an empty table stays empty.
    Meant for a stage among others: a task's encoder goes with the task, so workers that
    later stages use again hold no states and words."""
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    rows, kinds = _rows(docs, keep)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = _tokens(content.value)
        for batch in encoded_batches(batches, content.value, pattern, [*keep, "_text"]):
            column, texts = batch.column(len(keep) + 1), values(batch, "_text")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            same = [
                "".join(decode_stream(flat[a:b].tolist(), tokens, DECODED_IDS)).encode() == text
                for a, b, text in zip(offsets, offsets[1:], texts)
            ]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(offsets).astype(np.int64)), column, pa.array(same, pa.bool_())],
                names=[*keep, "n_tokens", "ids", "round_trip"],
            )
        _encoder.cache_clear()
        _tokens.cache_clear()

    return rows.mapInArrow(step, f"{kinds}, n_tokens bigint, ids array<int>, round_trip boolean")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """Encode, decode the ids and return counts and digests, in one pass."""
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    rows, kinds = _rows(docs, keep)
    return rows.mapInArrow(
        lambda it: digested_batches(encoded_batches(it, content.value, pattern, keep), content.value, keep),
        f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
