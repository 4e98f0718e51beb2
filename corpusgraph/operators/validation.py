"""Structural checks of triples, and the post-checks that a stage did its work."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.json_values import BLANK, INVALID, OK, OTHER, read_object
from corpusgraph.functions.text import is_blank

#: The keys of a triple, in the order in which their errors are named.
REQUIRED = ("ID1", "ID2", "PMID", "head", "head_type", "relation", "tail", "tail_type", "source_sentence", "score")
#: What is wrong with a line that is no triple.
LINE_REASONS = {BLANK: "Missing line value", INVALID: "Invalid JSON", OTHER: "JSON value is not an object"}


def _reasons(tests: list[tuple[str, Column, Column]]) -> Column:
    """The joined reasons of (key, absent, empty) tests; null if nothing is wrong."""
    found = []
    for key, absent, empty in tests:
        found += [F.when(absent, f"Missing {key} key"), F.when(absent | empty, f"Missing {key} value")]
    return F.nullif(F.array_join(F.array_compact(F.array(*found)), "; "), F.lit(""))


def check_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with ``reason``: null for a triple with all required values, else all that is wrong, joined by ``; ``.

    An absent key counts twice, for itself and its value; null, blank text and empty arrays and objects count once; zero
    and false are values.
    """
    read = lines.withColumn("__o", read_object(F.col(raw), list(REQUIRED)))
    keys = [(k, ~F.col(f"__o.{k}.present"), F.col(f"__o.{k}.empty")) for k in REQUIRED]
    reason = F.when(F.col("__o.status") == OK, _reasons(keys))
    for status, text in LINE_REASONS.items():
        reason = F.when(F.col("__o.status") == status, text).otherwise(reason)
    return read.withColumn("reason", reason).drop("__o")


def check_columns(triples: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """``triples`` with ``reason``, for triples that lie in columns; ``columns`` maps a required key to its column.

    A column that the table lacks is an absent key; null is an empty value.
    """
    columns = columns or {k: k for k in REQUIRED}
    kinds = dict(triples.dtypes)
    tests = []
    for key in REQUIRED:
        name = columns.get(key, key)
        if name not in kinds:
            tests.append((key, F.lit(True), F.lit(True)))
        elif kinds[name] == "string":
            tests.append((key, F.lit(False), is_blank(name)))
        else:
            tests.append((key, F.lit(False), F.col(name).isNull()))
    return triples.withColumn("reason", _reasons(tests))


def examples(checked: DataFrame, order: str, size: int = 10) -> DataFrame:
    """The first ``size`` faulty rows."""
    return checked.where("reason is not null").orderBy(order).limit(size)


def has_rare_types(counts: DataFrame, threshold: int) -> DataFrame:
    """One row (rare_types, any_rare): the post-check after rare types were taken out."""
    return counts.agg(F.count_if(F.col("count") < threshold).alias("rare_types")).withColumn("any_rare", F.when(F.col("rare_types") > 0, "Yes").otherwise("No"))


def assert_text(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """``rows``, failing as soon as a value of ``name`` is neither text nor null; ``kind`` holds the JSON kind."""
    wrong = ~F.coalesce(F.col(kind), F.lit("null")).isin("string", "null")
    return rows.withColumn(name, F.when(wrong, F.raise_error(F.concat(F.lit(f"{name} is a "), F.col(kind)))).otherwise(F.col(name)))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(correct, faulty) rows; keep or write the input first, so that it is computed once."""
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")
