"""Helpers that the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweft.session import materialize

WORD = r"[^\x20\x09-\x0D]+"  # in bytes: what bytes.split() returns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null: Python gets them without decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def keyed(docs: DataFrame, columns: list[str], key: str = "row_key") -> DataFrame:
    """``columns`` of the documents with a stable unique long.

    That is ``doc_id`` where it is unique and never null. Otherwise rows are
    numbered and stored, so that every later scan sees the same numbers.
    """
    rows = docs.select(*columns)
    unusable = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int") and unusable.isEmpty():
        return rows.withColumn(key, F.col("doc_id").cast("bigint"))
    return materialize(rows.withColumn(key, F.monotonically_increasing_id()), "keyed")


def boxed(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row), ``doc_id`` and ``text``: other columns can have any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")


def unboxed(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The rows of ``doc`` again; a new ``text`` also sets ``n_chars`` where there is one."""
    new = {} if text is None else {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    names = rows.schema["doc"].dataType.names
    return rows.select(*[(new[c] if c in new else F.col("doc")[c]).alias(c) for c in names])
