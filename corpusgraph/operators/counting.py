"""Frequencies, distinct values and token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip
from corpusgraph.operators.ordinals import with_ordinal


def value_counts(rows: DataFrame, columns: list[str], order: str, strip: bool = True) -> DataFrame:
    """(value, count, first): how often each value occurs in ``columns`` together, and where it was seen first.

    ``first`` counts places: all columns of the first row in order, then those of the next. With ``strip`` values are
    stripped and blank ones skipped; without, they count as they are. Null never counts.
    """
    n = len(columns)
    places = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("value"), (F.col(order) * n + i).alias("place")) for i, c in enumerate(columns)]))
    values = rows.select(places.alias("p")).select("p.*")
    values = values.withColumn("value", pystrip("value")).where("value != ''") if strip else values.where("value is not null")
    return values.groupBy("value").agg(F.count("*").alias("count"), F.min("place").alias("first"))


#: Orders of a report: by falling count with ties as first seen or by name, and by rising count likewise.
BY_COUNT = {
    "first_seen": lambda: [F.desc("count"), F.asc("first")],
    "name": lambda: [F.desc("count"), F.asc("value")],
    "rising_first_seen": lambda: [F.asc("count"), F.asc("first")],
    "rising_name": lambda: [F.asc("count"), F.asc("value")],
}


def ranked(counts: DataFrame, order: str = "first_seen") -> DataFrame:
    """(value, count, rank): the rows' place in the order of a report."""
    return with_ordinal(counts, "rank", *BY_COUNT[order]()).select("value", "count", "rank")


def literal_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, count) of a column whose null counts as the text ``None``, as for journals; blank values are skipped."""
    value = F.coalesce(pystrip(F.col(column)), F.lit("None"))
    return rows.select(value.alias("value")).where("value != ''").groupBy("value").agg(F.count("*").alias("count"))


def at_least(counts: DataFrame, least: int) -> DataFrame:
    """The values of a chart: those that occur at least so often. A negative number is refused."""
    if least < 0:
        raise ValueError("the least count must not be negative")
    return counts.where(F.col("count") >= least)


def below(counts: DataFrame, threshold: int) -> DataFrame:
    """The rare values."""
    return counts.where(F.col("count") < threshold)


def unique_entities(triples: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    """One row: distinct heads, distinct tails, and distinct entities of both, as they are; null never counts.

    The sides are kept as two flags of each distinct entity, so one pass over the entities gives all three counts.
    """
    ends = F.explode(F.array(F.struct(F.col(head).alias("e"), F.lit(1).alias("side")), F.struct(F.col(tail).alias("e"), F.lit(2).alias("side"))))
    by = triples.select(ends.alias("x")).select("x.*").where("e is not null").groupBy("e").agg(F.bit_or("side").alias("sides"))
    return by.agg(
        F.count_if(F.col("sides").bitwiseAND(F.lit(1)) > 0).alias("unique_heads"),
        F.count_if(F.col("sides").bitwiseAND(F.lit(2)) > 0).alias("unique_tails"),
        F.count("*").alias("total_unique"),
    )


def summary(triples: DataFrame, types: list[str], relation: str, head: str = "head", tail: str = "tail") -> DataFrame:
    """(metric, value), six rows: triples, entity types, relation types, and the three counts of unique entities."""

    def distinct(columns: list[str]) -> Column:
        return F.explode(F.array(*columns))

    parts = [
        triples.agg(F.count("*").alias("triples")),
        triples.select(distinct(types).alias("v")).agg(F.countDistinct("v").alias("entity_types")),
        triples.agg(F.countDistinct(relation).alias("relation_types")),
        unique_entities(triples, head, tail),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # each side is one row
    names = row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value")) for n in names])).alias("m")).select("m.*")


def whole_number(text: Column) -> Column:
    """The whole number that a text writes, with padding, a sign or single underscores between digits; null for all else."""
    bare = pystrip(text)
    return F.when(bare.rlike("^[+-]?[0-9]+(?:_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))


def token_range(usage: DataFrame, tokens: str, key: str, order: Column) -> DataFrame:
    """One row: the least and largest count, whose keys come first in ``order`` with them, how many counts are valid and
    invalid, their exact median (of two middle ones the mean) and mean. Without valid counts all but the last two are null."""
    n = F.col(tokens).try_cast("bigint")
    rows = usage.select(n.alias("n"), F.col(key).alias("k"), order.alias("o"))
    valid = F.col("n").isNotNull()
    return rows.agg(
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.min_by("k", F.when(valid, F.struct("n", "o"))).alias("min_key"),
        F.max_by("k", F.when(valid, F.struct(F.col("n"), -F.col("o")))).alias("max_key"),
        F.median("n").alias("median_tokens"),
        F.avg("n").alias("mean_tokens"),
        F.count("n").alias("valid"),
        F.count_if(~valid).alias("invalid"),
    )
