"""Raw log files as lines that know their place in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with ``file_key, block_start, line_id``, which sort in file order.

    The file's path is its key, at any number of files. Spark reads a big file in
    several splits and packs splits by size, so the row id alone is out of order; file
    and split start come first.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_key"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )


def stream_log(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A growing folder of log files as a stream of lines, oldest file first.

    A stream has no row numbers: ``line_id`` is 0 until :func:`number_lines`
    sets it inside ``foreachBatch``.
    """
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_key"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.lit(0).cast("bigint").alias("line_id"),
        )
    )


def number_lines(batch: DataFrame) -> DataFrame:
    """Row ids for the lines of one micro-batch, straight from its scan."""
    return batch.withColumn("line_id", F.monotonically_increasing_id())
