"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, part, line, raw): every line of the files with its number in its file, counted from 1, blank ones included.

    ``part`` is the file's place among all by name. Lines end at a line feed, a carriage return or both. A file may be read
    in any number of splits: rows of a split are numbered where they are read, and splits are added up by their start.
    """
    if not paths:
        return spark.createDataFrame([], "file string, part int, line bigint, raw string")
    text = spark.read.text(paths).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")
    )
    splits = text.groupBy("file", "split").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    # One row for each split of a file, so these windows are small.
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    parts = splits.select("file").distinct().withColumn("part", F.row_number().over(Window.orderBy("file")) - 1)
    return (
        text.join(F.broadcast(starts), ["file", "split"])
        .join(F.broadcast(parts), "file")
        .select("file", "part", (F.col("at") - F.col("low") + F.col("start") + 1).alias("line"), "raw")
    )


def read_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key): the distinct entries of text files with one on each line; blank lines are skipped."""
    return read_lines(spark, paths).select(pystrip("raw").alias("key")).where("key != ''").distinct()
