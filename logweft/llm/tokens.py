"""Token-id files: documents as Parquet list columns that can be read in part.

Documents are dealt to shards by ascending id, encoded there in order and written
as one file per shard. Ids are a list column, dictionary-coded (a vocabulary is far
smaller than a page of ids repeats), in row groups and pages of set sizes with page
indexes, so a reader can take a few documents, or counts without ids. A row knows its
place within its shard; places in the whole corpus come from the shards' totals.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from logweft.llm.common import text_bytes
from logweft.session import new_folder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
MOST_WORDS = 900_000  # remembered words of a worker, in two generations
OUT_BYTES = 2 << 20  # text bytes per batch
MARKS = b".,!?;:*&%$#"  # end words; never begin a contraction, which an apostrophe would
MARK = "|"  # stands between words that are encoded together
SCHEMA = "doc_id bigint, shard int, place bigint, start_in_shard bigint, n_tokens bigint, ids array<int>"


# What the fast way for single words takes for granted; any other file goes through the whole library.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = re.compile(r"[!-~¡-ſ]+")  # no composition, no white space, and lower case letter by letter
_PIECES = regex.compile(CUTS)


def _stand_ins() -> dict[int, str]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_STAND_INS = _stand_ins()


class WordEncoder:
    """A tokenizers file applied word by word.

    The tokenizers that this suits cut at white space and drop it, so a text's ids are
    those of its words one after the other. They also cut between letters and the marks
    after them, so a word of letters that ends in such marks is made of both. A new word
    of plain letters and marks goes straight to the library's merges, cut as the file says;
    other new words are encoded in one call per batch, with a mark between them.
    """

    def __init__(self, content: str):
        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        mark = self._ids(MARK)
        self._mark = mark[0] if len(mark) == 1 else None
        file = json.loads(content)
        known = file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == PRE_TOKENIZER
        self._merges = self._tokenizer.model if known else None

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _plain_ids(self, text: str) -> list[int]:
        low = text.lower()
        pieces = [low] if low.isalpha() else _PIECES.findall(low)
        named = pieces if low.isascii() else [p.encode().decode("latin-1").translate(_STAND_INS) for p in pieces]
        return [token.id for piece in named for token in self._merges.tokenize(piece)]

    def _learn(self, words: list[bytes]) -> None:
        rest = []
        for word in words:
            text = word.decode("utf-8", "replace")
            if self._merges is not None and PLAIN.fullmatch(text):
                self._young[word] = np.array(self._plain_ids(text), np.uint32).tobytes()
            else:
                rest.append(word)
        joinable = [w for w in rest if self._mark is not None and MARK.encode() not in w]
        for start in range(0, len(joinable), 256):
            part = joinable[start : start + 256]
            joined = f" {MARK} ".join(w.decode("utf-8", "replace") for w in part)
            (found,) = self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(ids == self._mark)
            if len(cuts) == len(part) - 1:
                self._young.update(
                    (w, ids[a:b].tobytes()) for w, a, b in zip(part, [0, *cuts + 1], [*cuts, len(ids)])
                )
        for word in rest:
            if word not in self._young:
                self._young[word] = np.array(self._ids(word.decode("utf-8", "replace")), np.uint32).tobytes()

    def _of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as bytes: remembered ones are looked up, others learned."""
        young, old, new, ended = self._young, self._old, set(), []

        def known(word: bytes) -> bool:
            if word in old:
                young[word] = old[word]
                return True
            return False

        for word in words:
            if word not in young and not known(word):
                bare = word.rstrip(MARKS)
                marks = word[len(bare) :]
                if marks and bare.decode("utf-8", "replace").isalpha():
                    ended.append((word, bare, marks))
                    new.update(part for part in (bare, marks) if part not in young and not known(part))
                else:
                    new.add(word)
        self._learn(sorted(new))
        for word, bare, marks in ended:
            young[word] = young[bare] + young[marks]
        out = [young[word] for word in words]
        if len(young) > MOST_WORDS // 2:
            self._old, self._young = young, {}
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end_id`` after it, and where each begins
        and the last ends. Words become numbers of distinct words first, in Arrow; only
        these are looked up, and their ids are gathered by number."""
        cut = pc.ascii_split_whitespace(texts.view(pa.string()))
        coded = cut.flatten().dictionary_encode()
        found = self._of(coded.dictionary.view(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        words = coded.indices.to_numpy()
        size = sizes[words]
        until = np.concatenate([[0], np.cumsum(size)])
        before = np.arange(len(texts) + 1)  # end ids of the texts in front
        edges = until[cut.offsets.to_numpy()] + before
        ids = np.full(edges[-1], end_id, np.uint32)
        held = np.ones(len(ids), bool)
        held[edges[1:] - 1] = False
        ids[held] = np.frombuffer(b"".join(found), np.uint32)[np.arange(until[-1]) + np.repeat(starts[words] - until[:-1], size)]
        return ids, edges


@lru_cache(maxsize=2)
def _encoder(content: str) -> WordEncoder:
    return WordEncoder(content)


def _encoded(batches: Iterator[pa.RecordBatch], content: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content)
    shard = TaskContext.get().partitionId()
    place = start = 0
    for batch in batches:
        texts, at = batch.column(1), 0
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        while at < len(texts):
            most = OUT_BYTES + (ends[at - 1] if at else 0)
            end = max(at + 1, int(np.searchsorted(ends, most, side="right")))
            ids, edges = encoder.encode(pa.concat_arrays([texts.slice(at, end - at)]), end_id)
            columns = [
                batch.column(0).slice(at, end - at),
                pa.array(np.full(end - at, shard, np.int32)),
                pa.array(np.arange(place, place + end - at)),
                pa.array(start + edges[:-1]),
                pa.array(np.diff(edges)),
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "shard", "place", "start_in_shard", "n_tokens", "ids"]
            )
            place, start, at = place + end - at, start + int(edges[-1]), end


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Encode every whole text (null: empty) with a tokenizers file and write shards.

    Order: ascending ``doc_id``, null first; rows of one id by a hash of their text,
    so repeated rows each get a place. Only ``doc_id`` and ``text`` are read.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    dealt = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    encoded = dealt.mapInArrow(lambda it: _encoded(it, content.value, end_id), SCHEMA)
    (
        encoded.write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as written, ids included."""
    return spark.read.schema(SCHEMA).parquet(folder)


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``shard`` and the ids before it: one row per file, from the counts alone."""
    totals = read(spark, folder).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: ``start`` in the corpus, ``n_tokens`` and the crc32 of its ids
    as little-endian unsigned 32-bit integers, all from the files."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(sums, pa.int64())],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, folder).select("doc_id", "shard", "start_in_shard", "n_tokens", "ids")
    summed = rows.mapInArrow(
        step, "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return summed.join(shard_starts(spark, folder), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write below the shared folder and return ``checked`` rows of what was written."""
    folder = new_folder(docs.sparkSession, "token-ids")
    write(docs, tokenizer, end_id, folder)
    return checked(docs.sparkSession, folder)
