"""Samples of articles that earlier samples did not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import text_or_none


def _key(key: str) -> Column:
    return text_or_none("empty", F.col(key))


def pool(articles: DataFrame, key: str, history: DataFrame, history_key: str, order: list[Column]) -> DataFrame:
    """The first row of each key, not blank, that ``history`` lacks."""
    seen = history.select(_key(history_key).alias("__key")).distinct()
    free = articles.withColumn("__key", _key(key)).where("__key != ''").join(seen, "__key", "left_anti")
    first = F.min_by(F.struct(*[F.col(c) for c in articles.columns]), F.struct(*order))
    return free.groupBy("__key").agg(first.alias("row")).select("row.*")


def drawn(candidates: DataFrame, key: str, size: int, seed: int | str | None = None) -> DataFrame:
    """At most ``size`` rows of ``candidates`` without repetition; with a seed always the same ones.

    The seeded order is that of the MD5 of key, colon, seed. Rows far beyond the sample leave before they are sorted: the
    MD5 is even, so a bound of ten standard deviations over the wanted share keeps the whole sample and little more.
    """
    stripped = _key(key)
    if seed is None:
        return candidates.orderBy(F.rand()).limit(size)
    place = F.md5(F.concat(stripped, F.lit(f":{seed}")))
    total = candidates.agg(F.count("*").alias("__total"))
    share = (size + 10 * size**0.5 + 100) / F.col("__total")
    near = F.conv(F.substring(place, 1, 12), 16, 10).cast("double") / float(1 << 48) <= share
    return candidates.crossJoin(F.broadcast(total)).where(near).drop("__total").orderBy(place, stripped).limit(size)


def totals(articles: DataFrame, key: str, history: DataFrame, history_key: str, index: str) -> DataFrame:
    """One row: samples, distinct keys and missing keys of the history, the next sample's number, and of the articles the
    rows, those without a key, those drawn before, and those that repeat a free key."""
    h = history.select(_key(history_key).alias("k"), F.col(index).alias("i")).agg(
        F.countDistinct("i").alias("samples"),
        F.countDistinct(F.nullif("k", F.lit(""))).alias("sampled_keys"),
        F.count_if(F.col("k") == "").alias("sampled_missing"),
        (F.coalesce(F.max("i"), F.lit(0)) + 1).alias("next_sample"),
    )
    seen = history.select(_key(history_key).alias("k")).where("k != ''").distinct().withColumn("seen", F.lit(True))
    by_key = articles.select(_key(key).alias("k")).groupBy("k").agg(F.count("*").alias("n")).join(seen, "k", "left")
    there, old = F.col("k") != "", F.coalesce("seen", F.lit(False))
    a = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(there & old, F.col("n"))), F.lit(0)).alias("drawn_before"),
        F.coalesce(F.sum(F.when(there & ~old, F.col("n") - 1)), F.lit(0)).alias("repeated"),
        F.count_if(there & ~old).alias("candidates"),
    )
    return h.crossJoin(a)
