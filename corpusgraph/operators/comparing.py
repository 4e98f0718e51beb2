"""Sets of keys and of terms held against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import text_or_none


def keys(rows: DataFrame, column: str) -> DataFrame:
    """(key): the distinct stripped keys, blank ones left out."""
    return rows.select(text_or_none("null", F.col(column)).alias("key")).where("key is not null").distinct()


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, side) of two tables of keys: ``shared``, ``only_a`` or ``only_b``. Both are read once."""
    both = a.select("key", F.lit(1).alias("side")).unionByName(b.select("key", F.lit(2).alias("side")))
    side = F.when(F.col("sides") == 3, "shared").when(F.col("sides") == 1, "only_a").otherwise("only_b")
    return both.groupBy("key").agg(F.bit_or("side").alias("sides")).select("key", side.alias("side"))


def sizes(found: DataFrame) -> DataFrame:
    """(side, keys) for all three sides, also empty ones."""
    names = F.explode(F.array(F.lit("shared"), F.lit("only_a"), F.lit("only_b")))
    sides = found.sparkSession.range(1).select(names.alias("side"))
    return sides.join(found.groupBy("side").agg(F.count("*").alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("keys"))


def numeric_first(key: str) -> list[Column]:
    """An order in which keys of digits come first, by their number, and all others after them, by their characters."""
    digits = F.col(key).rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.col(key).try_cast("decimal(38,0)")), F.col(key)]


def conformance(used: dict[str, DataFrame], defined: dict[str, DataFrame]) -> DataFrame:
    """(kind, term, side): terms that are used but not defined (``not_defined``), or defined but ``not_used``.

    ``used`` and ``defined`` have a table (term) for each kind.
    """
    out = None
    for kind in used:
        found = compared(used[kind].select(F.col("term").alias("key")).where("key is not null").distinct(), defined[kind].select(F.col("term").alias("key")).distinct())
        part = found.where("side != 'shared'").select(F.lit(kind).alias("kind"), F.col("key").alias("term"), F.when(F.col("side") == "only_a", "not_defined").otherwise("not_used").alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


def report(used_heads: DataFrame, used_tails: DataFrame, used_relations: DataFrame, differences: DataFrame, records: DataFrame) -> DataFrame:
    """The conformance report as one row: the record count, sorted arrays of what is used, and the four differences.

    The arrays hold distinct terms; they are meant for vocabularies, not for free text.
    """

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_set(column)).alias(name))

    def differing(kind: str, side: str, name: str) -> DataFrame:
        return listed(differences.where((F.col("kind") == kind) & (F.col("side") == side)), "term", name)

    parts = [
        records.agg(F.count("*").alias("records")),
        listed(used_heads, "term", "head_types"),
        listed(used_tails, "term", "tail_types"),
        listed(used_heads.select("term").unionByName(used_tails.select("term")), "term", "entity_types_union"),
        listed(used_relations, "term", "relations"),
        differing("entity_type", "not_defined", "entity_not_in_prompt"),
        differing("entity_type", "not_used", "entity_in_prompt_but_missing_in_data"),
        differing("relation", "not_defined", "relation_not_in_prompt"),
        differing("relation", "not_used", "relation_in_prompt_but_missing_in_data"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # each side is one row
    names = row.columns
    return row.select(*names[:5], F.struct(*names[5:]).alias("diff"))
