"""CSV and JSON sources with fixed schemas."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logweft import schemas

_CSV = {"header": True, "quote": '"', "escape": '"'}


def positioned(rows: DataFrame) -> DataFrame:
    """Add the source position of each row. Call it right after a file read."""
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("file_key"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Labelled traces, every field as text, in source order. The columns are
    checked against the header."""
    rows = spark.read.schema(schemas.TRACES_CSV).options(enforceSchema=False, **_CSV).csv(path)
    return positioned(rows)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS_CSV).options(**_CSV).csv(path)


def read_explanations(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one JSON array of explanation objects, in one task per file;
    ``json_array.read_json_array`` reads large ones in splits."""
    return positioned(spark.read.schema(schemas.EXPLANATIONS).json(path, multiLine=True))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.CHAT) -> DataFrame:
    """JSON lines in source order; blank and malformed lines are skipped, a
    missing path is empty."""
    corrupt = "_corrupt"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    try:
        rows = positioned(
            spark.read.schema(wide).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
        )
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        position = T.StructType.fromDDL("file_key string, block_start bigint, line_id bigint")
        return spark.createDataFrame([], T.StructType([*schema.fields, *position.fields]))
    filled = reduce(or_, [F.col(f"`{c}`").isNotNull() for c in schema.fieldNames()])
    return rows.filter(F.col(corrupt).isNull() & filled).drop(corrupt)
