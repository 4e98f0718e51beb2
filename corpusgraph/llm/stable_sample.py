"""A sample of keys that is the same on every run and keeps its members as the data grow.

Nested hash buckets: a key belongs for ever to one of 65,536 fine buckets, chosen by its MD5. The buckets stand in one
order, a permutation fixed by a seed. A sample is the keys of the first so many buckets in that order; a larger sample
takes more buckets of the same order, so it contains every smaller one, and new records only ever add members.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Buckets are divided by the first four hexadecimal digits of the MD5 of the key's text.
_DIGITS = 4


def bucket(key: Column) -> Column:
    """The bucket of a key; null for a null key. Keys are compared by their text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, _DIGITS), 16, 10).cast("int")


def order(seed: str = "0") -> list[int]:
    """All buckets in the order in which samples take them."""
    return sorted(range(BUCKETS), key=lambda b: (md5(f"{seed}:{b}".encode()).hexdigest(), b))


def _place(at: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), at.cast("string")))


def sample(rows: DataFrame, key: Column, share: float, seed: str = "0") -> DataFrame:
    """(key, bucket) of the sampled distinct keys: those of the first ``ceil(share * 65536)`` buckets.

    Rows whose key is null are left out; a key in many rows comes once. Membership is a property of the key alone:
    neither other rows, nor their order, nor the layout of the data matter. The test runs in the scan, so only sampled
    keys are shuffled, and repeated keys are reduced before that. An empty table gives an empty sample; other columns,
    whatever their names, are not read.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    taken = -int(-share * BUCKETS // 1)
    return _taken(rows, key, taken, seed).distinct()


def _taken(rows: DataFrame, key: Column, taken: int, seed: str) -> DataFrame:
    keys = rows.select(key.alias("key")).where("key is not null").withColumn("bucket", bucket(F.col("key")))
    if taken >= BUCKETS:
        return keys
    # The place of the first bucket that is not taken; all taken ones stand before it.
    last = order(seed)[taken]
    bound = md5(f"{seed}:{last}".encode()).hexdigest()
    return keys.where(_place(F.col("bucket"), seed) < bound)


def buckets_for(rows: DataFrame, key: Column, size: int, at_least: int = 0, seed: str = "0") -> int:
    """How many buckets give at least ``size`` keys, never fewer than ``at_least``, the number taken before.

    Call it when a sample is to have a size rather than a share, keep the number, and pass it as ``at_least`` next time:
    a list of buckets is only ever extended, so members stay even when more data would allow a shorter list. Only the
    65,536 bucket sizes reach the driver. If all keys are too few, all buckets are taken.
    """
    sizes = {
        r["bucket"]: r["n"]
        for r in rows.select(key.alias("key")).where("key is not null").distinct()
        .groupBy(bucket(F.col("key")).alias("bucket")).agg(F.count("*").alias("n")).collect()
    }
    total = 0
    for taken, b in enumerate(order(seed)):
        if total >= size:
            return max(taken, at_least)
        total += sizes.get(b, 0)
    return BUCKETS


def sample_of_buckets(rows: DataFrame, key: Column, taken: int, seed: str = "0") -> DataFrame:
    """(key, bucket) of the distinct keys in the first ``taken`` buckets; see ``sample``."""
    return _taken(rows, key, taken, seed).distinct()
