"""Texts cut off by a length limit of their source, or in transfer.

Per source, the lengths of its different texts are counted, in characters and in bytes. A limit shows as a spike: a
length that far more texts have than the lengths around it. A text at a spike without terminal punctuation is cut.

Texts broken in transfer share no length, but they break off as texts at a limit do: anywhere. So the texts at spikes are
the labelled sample of a linear model of ends, held against the open ends away from spikes, most of which are regular
(titles, references, signatures, lists). An open end that the model takes for one at a limit is cut in transfer. The
model sees the shape of what follows the last whole sentence, no words but short ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import WHITE_SPACE
from corpusgraph.session import durable

#: Signs of omission.
_OMITTED = r"(?i)(?:\.{3,}|…|&hellip;|[\[(<]\s*(?:\.{3}|…|more|read more|truncated|cut|continued|cont\.?)\s*[\])>])$"
_TAGS = r"(?:</?[a-zA-Z]{1,10}>\s*)+$"
#: Marks that end a sentence, with what may close behind them.
_SENTENCE = r"[.!?。！？｡][\"'”’»\)\]）】*]{0,3}$"
#: A number that breaks off behind its point, inside an open bracket.
_NUMBER = r"\([^()]*\d\.$"
#: From the end of a text backwards, what lies behind its last whole sentence.
_BEHIND = r"^(?s:.*?)(?=\s+[\"'”’»\)\]]*[.!?]\S|[。！？｡]|$)"
#: Features of an end are hashed to so many weights.
WEIGHTS = 1 << 14
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_IDEOGRAPH = re.compile("[㐀-鿿豈-﫿]")


def length_spikes(texts: DataFrame, text: str, source: str, least: int = 5, share: float = 0.01, times: float = 8.0) -> DataFrame:
    """(source, measure, size, texts, around): the lengths that stand out in a source, in characters and in bytes.

    A length stands out if at least ``least`` different texts and ``share`` of the source's texts have it, and ``times``
    as many as the lengths within five per cent of it have on average (``around``). Copies of a text count once, so that
    one text delivered a thousand times makes no spike. Null texts and null sources are left out.
    """
    sizes = (
        texts.select(F.col(source).alias("source"), F.xxhash64(text).alias("h"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"))
        .where("source is not null and chars > 0")
        .distinct()
    )
    counts = (
        sizes.select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("measure", "size"))
        .groupBy("source", "measure", "size")
        .agg(F.count("*").alias("texts"))
    )
    # Lengths on a logarithmic scale, a step of one thousandth: fifty steps are five per cent either way.
    scale = F.floor(F.log(F.col("size").cast("double")) * 1000)
    near = Window.partitionBy("source", "measure").orderBy("scale").rangeBetween(-50, 50)
    # From 50 texts on down, every length of a short text has its own step; the width of the window is counted in lengths.
    width = F.greatest(F.lit(1.0), F.col("size") * 0.1)
    whole = Window.partitionBy("source", "measure")
    return (
        counts.withColumn("scale", scale)
        .withColumn("around", (F.sum("texts").over(near) - F.col("texts")) / width)
        .withColumn("every", F.sum("texts").over(whole))
        .where((F.col("texts") >= least) & (F.col("texts") >= F.col("every") * share) & (F.col("texts") >= F.col("around") * times))
        .select("source", "measure", "size", "texts", "around")
    )


def _endings(texts: DataFrame, key: str, text: str, source: str, kind: Column) -> DataFrame:
    """(key, source, chars, bytes, kind, sign, behind, alone) of each text that does not end as a sentence ends.

    ``sign`` tells of a sign of omission, ``behind`` is what follows the last whole sentence, ``alone`` if there is none.
    """
    bare = F.rtrim(F.regexp_replace(F.rtrim(F.col(text), F.lit(WHITE_SPACE)), _TAGS, ""), F.lit(WHITE_SPACE))
    shown = texts.select(F.col(key).alias("key"), F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), kind.alias("kind"), bare.alias("bare"))
    # Nine texts in ten end as a sentence does; only the others are looked at more closely.
    open_ends = shown.where("bare != ''").where(F.col("bare").rlike(_OMITTED) | ~F.col("bare").rlike(_SENTENCE) | F.col("bare").rlike(_NUMBER))
    behind = F.reverse(F.regexp_extract(F.reverse("bare"), _BEHIND, 0))
    alone = F.length(behind) == F.length("bare")
    return open_ends.select("key", "source", "chars", "bytes", "kind", F.col("bare").rlike(_OMITTED).alias("sign"), behind.alias("behind"), alone.alias("alone"))


def _shape(token: str) -> str:
    if token.isdigit():
        return "9"
    if not token[0].isalpha():
        return token
    if _IDEOGRAPH.match(token):
        return "z"
    return "A" if len(token) > 1 and token.isupper() else "W" if token[0].isupper() else "w"


def features(behind: str, alone: bool, usual: bool) -> list[int]:
    """The hashed features of an end: shapes of its first and last tokens, its length, short last words, whether it is the
    whole text, and whether texts of its kind usually end open."""
    tokens = _TOKEN.findall(behind)
    shapes = [_shape(t) for t in tokens]
    first, last = shapes[:6], shapes[-8:]
    words = sum(s in "wWAz" for s in shapes)
    out = [f"alone {alone}", f"usual {usual}", f"words {min(words, 6) if words < 6 else words.bit_length() + 4}", f"whole {len(tokens) < 2}", "bias"]
    out += [f"first {' '.join(first[:n])}" for n in range(1, 5)] + [f"last {' '.join(last[-n:])}" for n in range(1, 5)]
    out += [f"has {p} {min(shapes.count(p), 3)}" for p in ":,;—–-\n/"]
    out.append(f"open {shapes.count('(') > shapes.count(')')} {shapes.count('[') > shapes.count(']')}")
    out.append(f"early {':' in first} {'-' in first or '–' in first or '—' in first} {first[:1]} {last[-1:]}")
    if tokens and len(tokens[-1]) <= 3:
        out.append(f"ends {tokens[-1].lower()}")
    return sorted({zlib.crc32(f.encode()) % WEIGHTS for f in out})


def _featured(ends: DataFrame) -> DataFrame:
    kind = ends.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(*end) for end in zip(batch["behind"], batch["alone"], batch["usual"], strict=True)]
            yield batch.drop(columns=["behind", "alone", "usual"]).assign(features=found)

    return ends.mapInPandas(run, f"key {kind}, source string, sign boolean, limit boolean, features array<int>")


def _flagged(judged: DataFrame, weights: np.ndarray) -> DataFrame:
    """The ends with a sign, at a spike, or which the model takes for one at a spike."""
    kind = judged.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            broken = np.array([weights[f].sum() > 0 for f in batch["features"]], bool)
            yield batch[broken | batch["sign"].to_numpy(bool) | batch["limit"].to_numpy(bool)].drop(columns="features")

    return judged.mapInPandas(run, f"key {kind}, source string, sign boolean, limit boolean")


def fit(rows: list[list[int]], at_limit: list[bool], rounds: int = 300, rate: float = 2.0, decay: float = 2e-3) -> np.ndarray:
    """The weights of a logistic regression of ``at_limit``; zero if one class is absent.

    Ends at limits weigh seven tenths, as broken texts are among the others, too.
    """
    weights, y = np.zeros(WEIGHTS), np.array(at_limit, float)
    if not 0 < y.sum() < len(y):
        return weights
    at, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weigh = np.where(y > 0, 0.7 / y.sum(), 0.3 / (1 - y).sum())
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.bincount(owner, weights[at], len(rows))))
        weights -= rate * (np.bincount(at, (weigh * (chance - y))[owner], WEIGHTS) + decay * weights)
    return weights


def _sampled(rows: DataFrame, key: str, count: int, most: int) -> DataFrame:
    """At most ``most`` of ``count`` rows, by the hash of the key; little more than those are sorted."""
    share = max(1, count // (2 * most))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(share)) == 0).orderBy(F.xxhash64(key), key).limit(most)


def _cut_at_limits(texts: DataFrame, key: str, text: str, limits: DataFrame, most: int) -> DataFrame:
    """At most ``most`` texts that are longer than some limit, cut at one of the limits, both chosen by the hash of the key."""
    sizes = limits.where("measure = 'chars'").select("size").distinct().orderBy(F.xxhash64("size")).limit(most)
    one = sizes.agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    size = F.get("sizes", F.pmod(F.xxhash64(key, F.lit("size")), F.size("sizes")).cast("int"))
    longer = texts.select(key, text).crossJoin(F.broadcast(one)).where(F.size("sizes") > 0).withColumn("at", size).where(F.length(text) > F.col("at"))
    chosen = _sampled(longer, key, longer.count(), most)
    return chosen.select(F.col(key), F.left(F.col(text), F.col("at")).alias(text), F.lit(None).cast("string").alias("source"))


def truncated(
    texts: DataFrame, key: str, text: str, source: str, kind: str | None = None, most: int = 4000, limits: DataFrame | None = None, **spikes: float
) -> DataFrame:
    """(key, source, reason, sign) of every cut text; ``reason`` is ``limit`` or ``transfer``, ``sign`` a sign of omission.

    ``key`` must be unique. ``kind`` names a column with kinds of text; where most texts of a kind end open, as titles do,
    the model of ends learns that an open end tells little. Null, empty and blank texts are never cut. A text that ends as a
    sentence ends is never cut, whatever its length; one with a sign of omission always is. Every copy of a cut text is
    reported. An empty table gives no rows; other columns, whatever their names, are not read.

    The model of ends is fitted on at most ``most`` open ends at spikes, as many other open ends, and as many texts that
    are cut at the found limits for the purpose, all chosen by the hash of the key. Where no limit shows there is nothing
    to learn from, and no text is taken for one broken in transfer. Spikes, a few rows for each source, are counted over
    all texts, or given as ``limits``. Only ends and lengths are shuffled.
    """
    found = durable(length_spikes(texts, text, source, **spikes) if limits is None else limits)
    chars = found.where("measure = 'chars'").select("source", F.col("size").alias("chars"), F.lit(True).alias("at_chars"))
    octets = found.where("measure = 'bytes'").select("source", F.col("size").alias("bytes"), F.lit(True).alias("at_bytes"))
    named = F.col(kind).cast("string") if kind else F.lit(None).cast("string")
    ends = durable(
        _endings(texts, key, text, source, F.coalesce(named, F.lit("")))
        .join(chars, ["source", "chars"], "left")
        .join(octets, ["source", "bytes"], "left")
        .select("key", "source", "sign", F.coalesce("at_chars", "at_bytes", F.lit(False)).alias("limit"), "behind", "kind", "alone")
    )
    every = texts.where(F.length(F.col(text)) > 0).groupBy(F.coalesce(named, F.lit("")).alias("kind")).agg(F.count("*").alias("every"))
    usual = ends.groupBy("kind").agg(F.count("*").alias("open")).join(every, "kind").select("kind", (F.col("open") * 2 > F.col("every")).alias("usual"))
    judged = durable(_featured(ends.join(usual, "kind").select("key", "source", "sign", "limit", "behind", "alone", "usual")))
    made = _endings(_cut_at_limits(texts, key, text, found, most), key, text, "source", F.lit(""))
    made = _featured(made.select("key", "source", "sign", F.lit(True).alias("limit"), "behind", "alone", F.lit(False).alias("usual")))
    sample = made.select("features", "limit")
    for at in (True, False):
        some = judged.where(~F.col("sign") & (F.col("limit") == at))
        sample = sample.unionByName(_sampled(some, "key", some.count(), most).select("features", "limit"))
    rows = sample.collect()
    weights = fit([r["features"] for r in rows], [r["limit"] for r in rows])
    return _flagged(judged, weights).select(F.col("key").alias(key), F.col("source").alias(source), F.when(F.col("limit"), "limit").otherwise("transfer").alias("reason"), "sign")


def source_shares(texts: DataFrame, cut: DataFrame, text: str, source: str) -> DataFrame:
    """(source, texts, cut, by_limit, share) for every source that has a text, blank ones not counted."""
    every = texts.where(F.regexp_like(F.col(text), F.lit(r"\S"))).groupBy(source).agg(F.count("*").alias("texts"))
    some = cut.groupBy(source).agg(F.count("*").alias("cut"), F.count_if(F.col("reason") == "limit").alias("by_limit"))
    return every.join(some, source, "left").select(
        source,
        "texts",
        F.coalesce("cut", F.lit(0)).alias("cut"),
        F.coalesce("by_limit", F.lit(0)).alias("by_limit"),
        (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"),
    )
