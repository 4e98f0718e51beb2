"""Deliveries merged into one table of articles: first wins, then filters, then numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import is_blank, pystrip
from corpusgraph.operators.ordinals import with_ordinal

#: A character that marks an abstract in another language, and a journal that is no journal.
FOREIGN_MARK = "的"
PREPRINTS = "bioRxiv : the preprint server for biology"


def judged(articles: DataFrame, key: str, abstract: str, journal: str, order: list[Column]) -> DataFrame:
    """``articles`` with ``verdict``: ``kept``, or the first reason that drops a row: ``dedup``, ``abstract``, ``journal``.

    A row is ``dedup`` if its key is blank or an earlier row has the same stripped key, even where that earlier row is
    itself dropped for its abstract or journal; so the test of repeats always comes before the filters. ``order`` must
    tell rows apart. The first place of each key is aggregated, not windowed, so a key in a third of all rows is reduced
    where its rows are.
    """
    keyed = articles.withColumn("__key", F.nullif(pystrip(F.col(key).cast("string")), F.lit(""))).withColumn("__at", F.struct(*order))
    firsts = keyed.where("__key is not null").groupBy("__key").agg(F.min("__at").alias("__first"))
    usable = ~is_blank(abstract) & ~F.contains(F.col(abstract), F.lit(FOREIGN_MARK))
    verdict = (
        F.when(F.col("__first").isNull() | (F.col("__at") != F.col("__first")), "dedup")
        .when(~usable, "abstract")
        .when(F.coalesce(F.col(journal), F.lit("")) == PREPRINTS, "journal")
        .otherwise("kept")
    )
    return keyed.join(firsts, "__key", "left").withColumn("verdict", verdict).drop("__key", "__at", "__first")


def merged(articles: DataFrame, key: str, abstract: str, journal: str, order: list[Column]) -> DataFrame:
    """The kept rows of ``judged``."""
    return judged(articles, key, abstract, journal, order).where("verdict = 'kept'").drop("verdict")


def drop_reasons(verdicts: DataFrame, batch: str) -> DataFrame:
    """(batch, total, kept, dedup, abstract, journal) for every batch."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "dedup", "abstract", "journal")]
    return verdicts.groupBy(batch).agg(F.count("*").alias("total"), *counts)


def union_roots(roots: list[DataFrame], label: str, labels: list[str]) -> DataFrame:
    """The rows of several roots with ``label`` and ``root``, the place of their root; columns that one lacks are null.

    A column named like the label that is there already wins over the label, unless it is null.
    """
    out = None
    for at, (df, value) in enumerate(zip(roots, labels, strict=True)):
        own = F.coalesce(F.col(label), F.lit(value)) if label in df.columns else F.lit(value)
        df = df.withColumn(label, own).withColumn("root", F.lit(at))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def numbered(articles: DataFrame, order: list[Column], name: str = "ID") -> DataFrame:
    """``articles`` with their running number as text, in front; a column of that name that is there already wins."""
    if name in articles.columns:
        return articles
    df = with_ordinal(articles, name, *order)
    return df.select(F.col(name).cast("string").alias(name), *articles.columns)
