"""Frequency of every distinct term, kept as one bitmap of record identifiers per term.

Vertical layout: a record gets a permanent number, a term's records are a set of such numbers cut into containers of
2**15, each a sorted list while sparse and a bitmap when dense, and the occurrence counters lie beside them. Layouts of
different batches merge by union; a term's document frequency is the cardinality of its containers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions.text import pystrip
from corpusgraph.session import durable

#: Numbers in a container: a bitmap of 4 KB.
CONTAINER = 1 << 15
#: Up to this many numbers a container is a list of two-byte numbers, beyond it a bitmap.
SPARSE = 1 << 10


def occurrences(rows: DataFrame, record: str, terms: dict[str, str], batch: Column | None = None) -> DataFrame:
    """(batch, kind, term, record, n): how often each record holds each term in each batch, of which there may be none.

    ``terms`` maps a column to the kind its values belong to; columns of one kind are counted together. Values and
    records are stripped of white space of any sort; blank values are skipped; a blank or null record gives null, which
    counts as an occurrence of the term but belongs to no record. The rows are counted before anything is shuffled, so a
    term or a record that holds a third of all rows costs one counter per task. An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(kind).alias("kind"), pystrip(F.col(c).cast("string")).alias("term")) for c, kind in terms.items()])
    )
    return (
        rows.select((F.lit("") if batch is None else batch.cast("string")).alias("batch"), F.nullif(pystrip(F.col(record).cast("string")), F.lit("")).alias("record"), pairs.alias("p"))
        .select("batch", "p.kind", "p.term", "record")
        .where("term != ''")
        .groupBy("batch", "kind", "term", "record")
        .agg(F.count("*").alias("n"))
    )


def number_records(records: DataFrame, buckets: int = 256) -> DataFrame:
    """(record, container, position): a number for every distinct record, without a global sort.

    A record's hash gives its bucket; inside the bucket records are ranked; every 2**15 ranks make one container. A
    bucket may hold any number of records. With more than about 10**9 records raise ``buckets`` so that a bucket still
    sorts inside a task.
    """
    bucket = F.pmod(F.xxhash64("record"), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("record")) - 1
    return (
        records.select("record")
        .where("record is not null")
        .distinct()
        .withColumn("bucket", bucket)
        .withColumn("rank", rank)
        .select(
            "record",
            (F.shiftrightunsigned("rank", 15).cast("bigint") * buckets + F.col("bucket")).alias("container"),
            (F.col("rank") % CONTAINER).cast("smallint").alias("position"),
        )
    )


@F.pandas_udf(T.BinaryType())
def _packed(lists: pd.Series, bitmaps: pd.Series) -> pd.Series:
    def one(positions, bitmap):
        if positions is None:
            return bitmap
        bits = np.zeros(CONTAINER, np.uint8) if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        bits[np.asarray(positions, np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    return pd.Series([one(p, b) for p, b in zip(lists, bitmaps, strict=True)], dtype=object)


def _settled(groups: DataFrame) -> DataFrame:
    """A container with a list and perhaps a bitmap, as either of them: only what is dense goes through Python."""
    dense = (F.size("list") > SPARSE) | F.col("bitmap").isNotNull()
    return groups.select(
        "kind",
        "term",
        "container",
        "n",
        F.when(~dense, F.col("list")).alias("list"),
        F.when(dense, _packed(F.when(dense, F.col("list")), F.col("bitmap"))).alias("bitmap"),
    )


def layout(counted: DataFrame, numbers: DataFrame) -> DataFrame:
    """(kind, term, container, n, list, bitmap): the vertical layouts of what ``occurrences`` gave, one for each batch.

    Container null holds the occurrences outside any record. A list and a bitmap are never both present, and neither can
    outgrow a task: a container has 2**15 positions at most.
    """
    return _settled(
        counted.join(numbers, "record", "left")
        .groupBy("batch", "kind", "term", "container")
        .agg(F.sum("n").alias("n"), F.collect_list("position").alias("list"))
        .withColumn("bitmap", F.lit(None).cast("binary"))
    )


def union(layouts: list[DataFrame]) -> DataFrame:
    """One layout of several, such as those of earlier batches and of a new one, whose records carry the same numbers."""
    every = reduce(DataFrame.unionByName, layouts)
    bits = F.bitmap_or_agg(F.coalesce("bitmap", F.lit(b""))).alias("bits")
    return _settled(
        every.groupBy("kind", "term", "container")
        .agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"), bits, F.count("bitmap").alias("dense"))
        .withColumn("bitmap", F.when(F.col("dense") > 0, F.col("bits")))
    )


def frequencies(vertical: DataFrame) -> DataFrame:
    """(kind, term, occurrences, records): both counts of every term, from counters and cardinalities."""
    cardinality = F.when(F.col("container").isNull(), F.lit(0)).otherwise(
        F.greatest(F.size("list"), F.lit(0)) + F.coalesce(F.bitmap_count("bitmap"), F.lit(0))
    )
    return vertical.groupBy("kind", "term").agg(
        F.sum("n").alias("occurrences"), F.sum(cardinality).cast("bigint").alias("records")
    )


def marked(counts: DataFrame, total: DataFrame, rare_below: int = 3, common_above: float = 0.4) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in under ``rare_below`` records, ``common`` in more than that share of ``total``.

    ``total`` is a table of one row with the column ``total``: the records of the whole collection. Terms that are
    neither have a null mark. With both true (a tiny collection) the mark is ``rare``.
    """
    return (
        counts.crossJoin(F.broadcast(total))
        .withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("total") * common_above, "common"))
        .drop("total")
    )


def term_frequencies(
    rows: DataFrame, record: str, terms: dict[str, str], rare_below: int = 3, common_above: float = 0.4, buckets: int = 256, batch: Column | None = None
) -> DataFrame:
    """(kind, term, occurrences, records, mark) for every distinct term of ``rows``; see ``occurrences`` and ``marked``.

    The collection is every distinct record that is not blank, whether or not it holds a term. A layout is built for each
    ``batch`` of rows, and the layouts are merged by union.
    """
    records = rows.select(F.nullif(pystrip(F.col(record).cast("string")), F.lit("")).alias("record"))
    numbers = durable(number_records(records, buckets))
    counts = frequencies(union([layout(occurrences(rows, record, terms, batch), numbers)]))
    return marked(counts, numbers.agg(F.count("*").alias("total")), rare_below, common_above)
