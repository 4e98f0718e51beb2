"""Texts as sets of word sequences, the exact likeness of two such sets, and the rare prefixes by which like sets meet.

Let two sets of n and m tokens have a likeness of t or more. Then they share at least t * n and t * m tokens. Take any
``prefix_length(n, t)`` tokens of the first: the tokens left out are fewer than those shared, so at least ``needed(n, t)``
of those taken are shared. If both prefixes are the first in one order of tokens, the shared ones lie in both prefixes.
More than one shared token is asked for, as two unlike texts often share one, but seldom several rare ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds are loosened by so much before they are rounded, as t * n or t / (1 + t) may lie above their true values.
LOOSE = 1e-6
#: A prefix is longer by one token for so many tokens of the set, and as many more tokens must be shared.
SPARE = 16


def words(text: Column) -> Column:
    """The unbroken runs of letters and digits of a text, in lower case; no words for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(word_list: Column, length: int) -> Column:
    """The set of hashes of all sequences of ``length`` words, in no order; fewer words count as one sequence."""
    at = F.sequence(F.lit(0), F.size(word_list) - length)
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(length)]))
    return F.array_distinct(F.when(F.size(word_list) >= length, runs).otherwise(F.array(F.xxhash64(word_list))))


def identity(word_list: Column) -> Column:
    """Equal for texts with the same words in the same order."""
    return F.concat_ws(".", F.hex(F.xxhash64(word_list)), F.hex(F.hash(word_list)), F.size(word_list))


def shingled(rows: DataFrame, key: str, text: Column, length: int, keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, <keep>, tokens, same): the set of each text, and ``same``, equal for texts of equal words."""
    kept = [c.alias(n) for n, c in (keep or {}).items()]
    split = rows.select(F.col(key).alias("key"), *kept, words(text).alias("w"))
    return split.select("key", *(keep or {}), shingles(F.col("w"), length).alias("tokens"), identity(F.col("w")).alias("same"))


def needed(n: Column, threshold: float) -> Column:
    """How many tokens of its prefix a set of ``n`` shares with every set that is like it."""
    return F.least(1 + F.floor(n / SPARE), F.ceil(n * threshold - LOOSE)).cast("int")


def prefix_length(n: Column, threshold: float) -> Column:
    return (n - F.ceil(n * threshold - LOOSE) + needed(n, threshold)).cast("int")


def counted(tokens: DataFrame) -> DataFrame:
    """(token, count) of the tokens in two sets or more, counted in each task before anything is shuffled."""
    return tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 1")


def placed(tokens: DataFrame) -> DataFrame:
    """(key, n, token, count, place) of rows (key, n, token, count): a token's place in its set, rarest first.

    Tokens that no other set holds may be missing: they come first in the order, so the places of the others are known
    from the end. The rows of a key are one text's tokens.
    """
    from_end = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), F.desc("token")))
    return tokens.withColumn("place", (F.col("n") - from_end).cast("int"))


def alike_lengths(na: Column, nb: Column, threshold: float) -> Column:
    return (nb >= na * threshold - LOOSE) & (na >= nb * threshold - LOOSE)


def meeting(posts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, part), a < b, of each shared token of two prefixes; for sets that are alike the parts add up to 1.

    ``posts`` has (token, key, n, place) of prefixes in one order. What lies behind the places must be able to make up
    the likeness.
    """
    a = posts.select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    b = posts.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    na, nb = F.col("na"), F.col("nb")
    need = F.least(needed(na, threshold), needed(nb, threshold))
    least = (na + nb) * (threshold / (1 + threshold)) - LOOSE - (need - 1)
    behind = F.least(na - F.col("pa"), nb - F.col("pb"))
    met = a.join(b.hint("merge"), "token").where((F.col("a") < F.col("b")) & alike_lengths(na, nb, threshold) & (behind >= least))
    return met.select("a", "b", (1 / need).alias("part"))


def enough(parts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose parts add up to 1."""
    return parts.groupBy("a", "b").agg(F.sum("part").alias("whole")).where(F.col("whole") >= 1 - LOOSE).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs (a, b) whose sets' common share is at least ``threshold``.

    ``sets`` has (key, tokens). The sets travel to the pairs by shuffles: a set is far larger than Spark supposes, so it
    must never be broadcast.
    """
    a = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(a.hint("merge"), "a")
        .join(b.hint("merge"), "b")
        .select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("both"))
        .select("a", "b", (F.col("common") / (F.col("both") - F.col("common"))).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )
