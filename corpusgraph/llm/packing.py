"""Texts into containers of fixed capacity, with as little unused room as possible.

Vector bin packing by the dot-product heuristic: a container is filled with the item whose demands point most along what
room is left, among those that fit all limits at once - tokens, segments and loss-bearing tokens - until none fits. An
item is split only if it alone exceeds the capacity.

Items are spread over groups of bounded size by the hash of their key and packed group by group; containers that stayed
too empty, a few for each group, are emptied again and their items packed together in later rounds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.session import durable

#: Fixed value: how byte-level BPE divides a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: a tag of markup.
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def tokenizer(path: str):
    """The byte-level BPE whose ranks lie at ``path``, loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(key, tokens, loss) for every row; a null or empty text has no tokens. ``ranks`` must be readable on every executor.

    Loss-bearing are the tokens of a text without its markup, and of equal texts only those of the one with the smallest
    key, so that nothing is learned twice. For this, hashes of texts are shuffled, not texts.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(ranks).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch["text"]]
            bare = [len(encode(MARKUP.sub("", t))) if "<" in t else n for t, n in zip(batch["text"], tokens, strict=True)]
            yield pd.DataFrame({"key": batch["key"], "same": batch["same"], "tokens": tokens, "bare": np.minimum(bare, tokens)})

    value = F.coalesce(F.col(text), F.lit(""))
    shown = texts.select(F.col(key).alias("key"), value.alias("text"), F.md5(value).alias("same"))
    counted = durable(shown.mapInPandas(run, f"key {kind}, same string, tokens bigint, bare bigint"))
    first = counted.groupBy("same").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("first"))
    return counted.join(first, "key", "left").select("key", "tokens", F.when(F.col("first"), F.col("bare")).otherwise(0).alias("loss"))


def fill(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(container, position) of each item; ``demands`` has a row for each item, none of which exceeds ``limits``.

    Items with equal demands are one kind, so a step costs as much as there are kinds that are left. Among equally good
    kinds the larger comes first, and of one kind the earlier item, so equal input gives equal output.
    """
    if (demands > limits).any():
        raise ValueError("an item exceeds a limit by itself")
    kinds, kind = np.unique(-demands, axis=0, return_inverse=True)
    kinds, kind = -kinds, kind.ravel()
    members = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    nexts = np.concatenate(([0], np.cumsum(left)[:-1]))
    share = kinds / limits
    container, position = np.empty(len(demands), np.int64), np.empty(len(demands), np.int64)
    now, done = 0, 0
    alive = np.arange(len(kinds))
    while done < len(demands):
        room, at = limits.copy(), 0
        fits = alive
        while True:
            fits = fits[(kinds[fits] <= room).all(1) & (left[fits] > 0)]
            if not len(fits):
                break
            # A unit more of a scarcer resource weighs more, as the room left of it is smaller.
            best = fits[np.argmax(share[fits] @ (room / limits))]
            item = members[nexts[best]]
            container[item], position[item] = now, at
            nexts[best] += 1
            left[best] -= 1
            room = room - kinds[best]
            at, done = at + 1, done + 1
        now += 1
        alive = alive[left[alive] > 0]
    return container, position


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(key, piece, tokens): an item of at most ``capacity`` as it is, a larger one as full pieces and a rest."""
    number = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    cut = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1)))
    return cut.withColumn("tokens", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint"))


def _round(items: DataFrame, group: str, groups: int, limits: tuple[int, int, int]) -> DataFrame:
    """(group, key, piece, tokens, loss, local, position, used): a packing of each group by itself."""
    kind = items.schema["key"].dataType.simpleString()
    most = np.array(limits, np.int64)

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["key", "piece"], ignore_index=True)
        demands = np.stack((batch["tokens"].to_numpy(), np.ones(len(batch), np.int64), np.minimum(batch["loss"].to_numpy(), most[2])), 1)
        container, position = fill(demands, most)
        used = np.bincount(container, batch["tokens"].to_numpy(), minlength=container.max() + 1)
        return batch.assign(local=container, position=position, used=used[container].astype(np.int64))

    schema = f"group bigint, key {kind}, piece int, tokens bigint, loss bigint, local bigint, position bigint, used bigint"
    named = items.select(F.expr(group).cast("bigint").alias("group"), "key", "piece", "tokens", "loss")
    # As many tasks as groups, whatever their size; a number of its own is not coalesced.
    return named.repartition(groups, "group").groupBy("group").applyInPandas(pack, schema)


def pack(
    counts: DataFrame, capacity: int = 2048, segments: int = 256, loss: int | None = None, per_group: int = 20_000, full: float = 0.99
) -> DataFrame:
    """(key, piece, container, position, tokens) for every item of (key, tokens[, loss]).

    ``loss`` is the limit on loss-bearing tokens, by default the capacity; without a column ``loss`` all tokens bear loss.
    Containers are numbered from 0 without gaps, positions from 0 in each. An item without tokens takes no room, but a
    segment. ``key`` must be unique. No limit is ever exceeded, but by an item that has more loss-bearing tokens than
    ``loss`` by itself: it is not split for that, and only items without any join it. No item of at most ``capacity`` is split; pieces of a
    larger one are numbered in ``piece``, and of its loss-bearing tokens each piece bears its share, rounded up. An empty
    table gives no rows. Other columns, whatever their names, are not read.

    A group holds about ``per_group`` items whatever the size of the data; the hash of the key spreads them evenly.
    Containers filled to less than ``full`` go into the next round, at most three in all.
    """
    bearing = F.col("loss") if "loss" in counts.columns else F.col("tokens")
    whole = counts.select("key", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(bearing, F.lit(0)).cast("bigint").alias("bearing"))
    parts = pieces(whole.withColumn("whole", F.greatest("tokens", F.lit(1))), capacity)
    items = durable(parts.select("key", "piece", "tokens", F.least(F.ceil(F.col("bearing") * F.col("tokens") / F.col("whole")), F.col("tokens")).cast("bigint").alias("loss")))
    limits = (capacity, segments, capacity if loss is None else loss)
    kept: list[DataFrame] = []
    left = items
    for at in range(3):
        number = left.count()
        if not number and kept:
            break
        groups = max(1, -(-number // per_group))
        packed = durable(_round(left, f"pmod(xxhash64(key, piece, {at}), {groups})", groups, limits))
        if at == 2 or groups == 1:
            kept.append(packed.withColumn("round", F.lit(at)))
            break
        enough = F.col("used") >= capacity * full
        kept.append(packed.where(enough).withColumn("round", F.lit(at)))
        left = packed.where(~enough)
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    # One row for each container of a group's round; the running number is over groups, of which there are few.
    names = every.select("round", "group", "local").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("round", "group").orderBy("local")) - 1)
    sizes = names.groupBy("round", "group").agg(F.count("*").alias("n"))
    before = Window.orderBy("round", "group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (
        every.join(names, ["round", "group", "local"])
        .join(starts.select("round", "group", "start"), ["round", "group"])
        .select("key", "piece", (F.col("start") + F.col("nth")).cast("bigint").alias("container"), "position", "tokens")
    )
