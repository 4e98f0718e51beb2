"""Contiguous runs of one key in a file, and keys that come back after others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip
from corpusgraph.operators.ordinals import with_ordinal_in


def runs(lines: DataFrame, key: Column, line: str, dense: str | None = None) -> DataFrame:
    """(key, start_line, end_line, record_count) of every run of equal keys.

    ``line`` is the physical number of a line, ``dense`` its number among the lines that count, by default the same.
    Within a run the dense number grows as fast as the number of lines with that key, so their difference names the run;
    no window spans the whole file. Lines with a null key are none of the lines that count.
    """
    rows = lines.select(key.alias("key"), F.col(line).alias("line"), F.col(dense or line).alias("dense")).where("key is not null")
    return (
        with_ordinal_in(rows, "nth", "key", "dense")
        .withColumn("run", F.col("dense") - F.col("nth"))
        .groupBy("key", "run")
        .agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("record_count"))
        .drop("run")
    )


def segments(found: DataFrame) -> DataFrame:
    """The runs with ``segment``, their number among those of the same key."""
    return with_ordinal_in(found, "segment", "key", "start_line")


def repeated(found: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The numbered runs of keys that have more than one; with ``targets`` (key) only of those keys.

    Without rows in ``targets`` all keys are reported, as if none had been named.
    """
    several = found.groupBy("key").agg(F.count("*").alias("segments")).where("segments > 1")
    if targets is not None:
        wanted = targets.select(pystrip("key").alias("key")).where("key != ''").distinct()
        some = wanted.agg((F.count("*") > 0).alias("some"))
        named = several.join(wanted.withColumn("wanted", F.lit(True)), "key", "left").crossJoin(F.broadcast(some))
        several = named.where("wanted or not some").drop("wanted", "some")
    return segments(found.join(several, "key"))


def collected(repeats: DataFrame) -> DataFrame:
    """(key, segments): the runs of a key as one sorted array."""
    one = F.struct("start_line", "end_line", "record_count")
    return repeats.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("segments"))
