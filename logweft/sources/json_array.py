"""Files of one JSON array each, read in splits.

A JSON array cannot be cut blindly: whether a brace counts depends on all quotes before
it. So the file is read as chunks that end at a closing brace, over as many splits as it
has, and each chunk tells how many quotes it has and, once it is known whether it begins
inside a string, by how much it changes the depth of brackets. Running totals over the
chunks, in cells of the source order, give each chunk its state; a chunk that closes an
object right inside the array ends a record, and the chunks of a record are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logweft.operators.ranking import LINE_CELL_BITS, running_totals
from logweft.session import materialize
from logweft.sources.tables import positioned

_CELLS = lambda: [F.struct("block_start", F.shiftright("line_id", LINE_CELL_BITS))]
_ORDER = ["block_start", "line_id"]


def record_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record`` (the JSON text of one object of the array), ``file_key`` and ``record_id``,
    its number in the file from 0. Nested objects and arrays, brackets, quotes and escapes
    in strings, and any white space between records are fine; the array holds objects only."""
    chunks = materialize(positioned(spark.read.option("lineSep", "}").text(path)), "json-chunks")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, which no chunk cuts in two
    counted = chunks.withColumns({"_plain": plain, "_quotes": F.regexp_count(plain, F.lit('"'))})
    quoted = running_totals(counted, ["file_key"], _CELLS(), _ORDER, {"_q": F.col("_quotes")})
    inside = (F.col("_q") - F.col("_quotes")) % 2 == 1
    head = F.when(inside, F.regexp_replace("_plain", r'^[^"]*("|$)', "")).otherwise(F.col("_plain"))
    outer = F.regexp_replace(head, r'"[^"]*("|$)', "")
    closes = F.col("_q") % 2 == 0  # the brace that ends the chunk stands outside strings
    step = F.regexp_count(outer, F.lit(r"[\[{]")) - F.regexp_count(outer, F.lit(r"\]")) - closes.cast("int")
    stepped = quoted.select("value", "file_key", *_ORDER, closes.alias("_closes"), step.alias("_step"))
    deep = running_totals(stepped, ["file_key"], _CELLS(), _ORDER, {"_depth": F.col("_step")}, store=True)
    ended = deep.withColumn("_ends", (F.col("_closes") & (F.col("_depth") == 1)).cast("bigint"))
    numbered = running_totals(ended, ["file_key"], _CELLS(), _ORDER, {"_until": F.col("_ends")}, store=True)
    pieces = numbered.withColumn("record_id", F.col("_until") - F.col("_ends"))
    joined = pieces.groupBy("file_key", "record_id").agg(
        F.array_sort(F.collect_list(F.struct(*_ORDER, "value"))).alias("_parts"), F.max("_ends").alias("_whole")
    )
    text = F.concat(F.array_join(F.col("_parts")["value"], "}"), F.lit("}"))
    return joined.filter("_whole = 1").select(
        F.regexp_replace(text, r"^[\s,\[\x{FEFF}]+", "").alias("record"), "file_key", "record_id"
    )


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The array's objects as rows, with their place in the source as ``tables.positioned``
    gives it. A record that is no valid JSON has nulls, as in Spark's own reader."""
    rows = record_texts(spark, path).withColumn("_row", F.from_json("record", schema))
    return rows.select(
        "_row.*", "file_key", F.lit(0).cast("bigint").alias("block_start"), F.col("record_id").alias("line_id")
    )
