"""Running numbers over a whole table, and ranks, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip
from corpusgraph.session import durable

_IN_PARTITION = (1 << 33) - 1


def with_ordinal(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``, 1 for the first row in ``order``, 2 for the next, and so on.

    Rows are sorted by ranges, kept, counted by partition, and numbered from their partition's start. Only the counts,
    one for each partition, meet in one task. ``order`` must tell rows apart where their numbers matter.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = durable(
        placed.withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33))
        .withColumn("__row", F.col("__row").bitwiseAND(F.lit(_IN_PARTITION)))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        kept.join(F.broadcast(starts), "__part")
        .withColumn(name, (F.col("__start") + F.col("__row") + 1).cast("bigint"))
        .drop("__part", "__row", "__start")
    )


def with_ordinal_in(df: DataFrame, name: str, key: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``, the number of a row among those of the same ``key``, in ``order``; null is a key, too.

    All rows are numbered by key and order at once, and the number before a key's first row is taken off. So the rows of
    a key that holds a third of the table are sorted by several tasks, where a window would send them to one.
    """
    every = with_ordinal(df, "__all", key, *order)
    starts = every.groupBy(F.col(key).alias("__key")).agg(F.min("__all").alias("__low"))
    return every.join(starts, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__all") - F.col("__low") + 1).drop("__all", "__key", "__low")


def add_ids(triples: DataFrame, key: str, order: str, first: str = "ID1", second: str = "ID2") -> DataFrame:
    """``first``, the running number of a triple, and ``second``, its number among those of the same ``key``, in front.

    Columns of these names that are there already give way. Keys are compared as they are, without stripping; null is a
    key of its own.
    """
    old = [c for c in triples.columns if c not in (first, second)]
    numbered = with_ordinal(triples.select(*old), "__first", order)
    both = with_ordinal_in(numbered, "__second", key, "__first")
    return both.select(F.col("__first").cast("string").alias(first), F.col("__second").cast("string").alias(second), *old)


def first_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(key, first): every distinct key that is not blank, stripped, with the least ``order`` it was seen at."""
    keys = rows.select(pystrip(key.cast("string")).alias("key"), F.col(order).alias("order"))
    return keys.where("key != ''").groupBy("key").agg(F.min("order").alias("first"))
