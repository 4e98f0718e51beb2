"""Language of texts and of each stretch in another language, with a confidence.

A linear softmax over averaged embeddings of hashed subwords, trained by stochastic gradient descent in numpy on a bounded
sample of the labelled rows themselves. Labels are partly wrong, so sentences whose label is contradicted by a model of the
other half of the rows are left out. Confidence is calibrated on held-out sentences, and a sentence below the confidence at
which accepted ones are right often enough is rejected: it counts for no language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip

#: How labels name the languages: two and three letters, English and own names.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "中文", "mandarin"),
}
LANGUAGES = tuple(NAMES)
_BY_NAME = {name: code for code, names in NAMES.items() for name in names}

_IDEOGRAPH = "㐀-鿿豈-﫿"
_WORD = re.compile(rf"[^\W\d_{_IDEOGRAPH}]+|[{_IDEOGRAPH}]+")
#: A sentence ends behind its mark if a blank follows, or behind a mark of ideographic script.
_BREAK = re.compile(rf"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*\s*|(?<=[\w)%][.!?])(?=[A-Z][a-z]+ |[{_IDEOGRAPH}])|\n+")
#: The heading of a part of an abstract.
_HEADING = re.compile(r"^\s*[^\W\d_][^.!?:。\n]{1,40}:\s+")


def label_language(label: Column) -> Column:
    """The two letters a label stands for (``eng``, ``English`` and ``en-US`` are ``en``); null if it names none of them."""
    base = F.regexp_extract(F.lower(pystrip(label)), r"^(\p{L}+)(?:[-_](?:\p{L}|\d)+)*$", 1)
    table = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    return F.try_element_at(table, base)


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(start, sentence) of every sentence; headings of parts belong to none."""
    out, at = [], 0
    for gap in [*_BREAK.finditer(text or ""), None]:
        end = gap.start() if gap else len(text or "")
        piece = (text or "")[at:end]
        heading = _HEADING.match(piece)
        if heading and piece[: heading.end()].split(":")[0].isupper() or heading and re.search(f"[{_IDEOGRAPH}]", heading[0]):
            at, piece = at + heading.end(), piece[heading.end() :]
        if piece.strip():
            out.append((at, piece))
        at = gap.end() if gap else end
    return out


#: What stands in a field in place of a text.
_PLACEHOLDER = re.compile(r"^\W*(?:no abstract(?: is)? available|abstract not available|not available|n/?a|none)\W*$", re.IGNORECASE)


def plain(text: str) -> str:
    """Without accents, as some deliveries lose them."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def subwords(word: str, buckets: int) -> list[int]:
    """The buckets of a word and of its runs of two to four characters; of ideographs, runs of one and two."""
    if "㐀" <= word[0] <= "鿿":
        parts = [word[i : i + n] for n in (1, 2) for i in range(len(word) - n + 1)]
    else:
        marked = f"<{word}>"
        parts = [marked, *(marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(p.encode()) % buckets for p in parts]


@dataclass
class Model:
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    least: int = 4
    words: dict[str, int] = field(default_factory=dict)
    #: Words that a task remembers; beyond it the memory is emptied, so it can't grow with the data.
    most: int = 200_000

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}}

    def _vectors(self, texts: list[list[str]]) -> np.ndarray:
        """The averaged embedding of each list of words."""
        if not hasattr(self, "_table") or len(self.words) > self.most:
            self.words, self._table, self._count = {}, np.zeros((1024, self.embeddings.shape[1] + 1), np.float32), 0
        ids = np.fromiter((self._word(w) for t in texts for w in t), np.int64)
        sizes = np.fromiter((len(t) for t in texts), np.int64)
        out = np.zeros((len(texts), self._table.shape[1]), np.float32)
        full = sizes > 0
        if len(ids):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
            out[full] = np.add.reduceat(self._table[ids], starts, axis=0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)

    def _word(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            at = self.words[word] = self._count
            self._count += 1
            if at == len(self._table):
                self._table = np.concatenate((self._table, np.zeros_like(self._table)))
            parts = subwords(word, len(self.embeddings))
            self._table[at, :-1] = self.embeddings[parts].sum(0)
            self._table[at, -1] = len(parts)
        return at

    def probabilities(self, texts: list[str]) -> np.ndarray:
        logits = self._vectors([_WORD.findall(t.lower()) for t in texts]) @ self.weights + self.bias
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text as an index, -1 where rejected, and its confidence.

        A text of fewer than ``least`` words, or of fewer than twice as many ideographs, says too little.
        """
        if not texts:
            return np.zeros(0, int), np.zeros(0)
        p = self.probabilities(texts)
        best, sure = p.argmax(1), p.max(1)
        enough = np.fromiter((_amount(t) >= self.least for t in texts), bool)
        return np.where((sure >= self.threshold) & enough, best, -1), sure


def _amount(text: str) -> float:
    found = _WORD.findall(text)
    ideographs = sum(len(w) for w in found if "㐀" <= w[0] <= "鿿")
    return sum(1 for w in found if not "㐀" <= w[0] <= "鿿") + ideographs / 2


def _fit(texts: list[str], labels: np.ndarray, buckets: int, size: int, steps: int, seed: int) -> Model:
    """``steps`` steps of gradient descent, each over 32 sentences, however many sentences there are.

    Sentences of a rare label count for more, but at most for ten times as much as those of a common one: where labels are
    wrong, a rare label stands on more texts of the common language than that weight could hide.
    """
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (buckets, size)).astype(np.float32)
    weights, bias = np.zeros((size, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32)
    parts = cache(lambda word: subwords(word, buckets))
    features = [np.array([b for w in _WORD.findall(t.lower()) for b in parts(w)] or [0], np.int64) for t in texts]
    share = np.bincount(labels, minlength=len(LANGUAGES)).astype(np.float32)
    balance = (len(labels) / np.maximum(share, 1) / len(LANGUAGES))[labels].astype(np.float32)
    batch, order = 32, np.zeros(0, np.int64)
    for step in range(steps):
        while len(order) < batch:
            order = np.concatenate((order, rng.permutation(len(texts))))
        some, order = order[:batch], order[batch:]
        ids = np.concatenate([features[i] for i in some])
        sizes = np.array([len(features[i]) for i in some])
        mean = np.add.reduceat(embeddings[ids], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
        z = mean @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(some)), labels[some]] -= 1
        p *= np.clip(balance[some], 0.3, 3)[:, None]
        rate = 1 - step / steps
        # A subword's share of a sentence is small, so embeddings take longer steps than the layer above them.
        back = np.repeat((rate * p @ weights.T / sizes[:, None] * 10).astype(np.float32), sizes, axis=0)
        weights -= rate * (mean.T @ p) / len(some) * 2
        bias -= rate * p.mean(0) * 0.1
        for d in range(size):
            embeddings[:, d] -= np.bincount(ids, back[:, d], buckets)
    return Model(embeddings, weights, bias)


def _calibrated(model: Model, texts: list[str], labels: np.ndarray, right: float) -> Model:
    """The temperature under which held-out labels are likeliest, and the least confidence with ``right`` of them right."""
    scores = []
    for t in np.geomspace(0.1, 4, 25):
        model.temperature = float(t)
        p = model.probabilities(texts)[np.arange(len(texts)), labels]
        scores.append((-np.log(np.maximum(p, 1e-9)).mean(), float(t)))
    model.temperature = min(scores)[1]
    p = model.probabilities(texts)
    order = np.argsort(-p.max(1))
    good = np.cumsum(p.argmax(1)[order] == labels[order]) / np.arange(1, len(order) + 1)
    kept = np.nonzero(good >= right)[0]
    model.threshold = float(np.clip(p.max(1)[order][kept[-1]] if len(kept) else 0.99, 0.5, 0.99))
    return model


def _agreed(texts: list[str], labels: np.ndarray, half: np.ndarray, fit) -> np.ndarray:
    """The places of sentences whose label a model agrees with that has seen only rows of the other half. A model that has
    seen a wrong label may have learnt it by heart, so no sentence is judged by its own half."""
    kept = np.zeros(len(texts), bool)
    for other in (0, 1):
        ours, theirs = np.nonzero(half != other)[0], np.nonzero(half == other)[0]
        if not len(ours) or not len(theirs):
            kept[ours] = True
            continue
        p = fit([texts[i] for i in theirs], labels[theirs]).probabilities([texts[i] for i in ours])
        kept[ours] = p.argmax(1) == labels[ours]
    return np.nonzero(kept)[0]


def train(
    rows: DataFrame, key: str, text: list[str], label: str, most: int = 3000, buckets: int = 1 << 14, size: int = 8,
    steps: int = 2400, right: float = 0.995, seed: int = 7,
) -> Model:
    """A model from at most ``most`` labelled rows, the ones with the lowest hash of their key.

    The rows come in the proportions of the collection: of each language most labels are right, while of a rare label many
    may be wrong. The sample is all that reaches the driver. A language without labelled rows is never found. With no labelled rows at all every text is
    rejected.
    """
    labelled = rows.select(label_language(F.col(label)).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(text)])
    texts, labels, half = [], [], []
    labelled = labelled.where("lang is not null")
    # Hashes under a bound leave little more than the sample, so that tasks don't each send as many rows as it has.
    bound = min(1.0, (most + 10 * most**0.5 + 100) / max(1, labelled.count()))
    few = labelled.where(F.pmod("h", F.lit(1 << 40)) < int(bound * (1 << 40))) if bound < 1 else labelled
    for n, row in enumerate(few.orderBy(F.pmod("h", F.lit(1 << 40)), "h").limit(most).collect()):
        for j in range(len(text)):
            for _, s in sentences(row[f"t{j}"]):
                if _amount(s) >= 4:
                    texts.append(s)
                    labels.append(LANGUAGES.index(row["lang"]))
                    half.append(n % 2)
    if not texts:
        return Model(np.zeros((buckets, size), np.float32), np.zeros((size, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), threshold=2.0)
    target = np.array(labels)
    kept = _agreed(texts, target, np.array(half), lambda t, y: _fit(t, y, buckets, size, steps // 2, seed))
    rng = np.random.default_rng(seed)
    held = rng.random(len(kept)) < 0.1
    fitted = [texts[i] for i in kept[~held]]
    bare = [plain(t) for t in fitted]
    twice = np.concatenate((target[kept[~held]], target[kept[~held]]))
    model = _fit(fitted + bare, twice, buckets, size, steps, seed)
    if held.any():
        model = _calibrated(model, [texts[i] for i in kept[held]], target[kept[held]], right)
    return model


def segments(rows: DataFrame, key: str, text: list[str], model: Model) -> DataFrame:
    """(key, field, start, length, sentences, lang, confidence) of each stretch of sentences in one language.

    A title, the first of ``text``, is one sentence. Sentences that are rejected belong to the stretch around them, and
    make none of their own. Lengths and starts are in code points. Null and blank texts give no rows; texts of any length
    are read whole, sentence by sentence. ``key`` may have any type and need not be unique. Nothing is shuffled.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, field string, start bigint, length bigint, sentences bigint, lang string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [(k, f, at, s) for k, *values in batch.itertuples(index=False, name=None) for f, v in zip(text, values, strict=True) for at, s in _pieces(f == text[0], v)]
            best, sure = model.judge([p[3] for p in pieces])
            yield pd.DataFrame(list(_stretches(pieces, best, sure)), columns=["key", "field", "start", "length", "sentences", "lang", "confidence"])

    return rows.select(F.col(key).alias("key"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(text)]).mapInPandas(run, schema)


def _pieces(title: bool, value: str | None) -> list[tuple[int, str]]:
    if not isinstance(value, str) or not value.strip() or _PLACEHOLDER.match(value):
        return []
    return [(0, value)] if title else sentences(value)


def _stretches(pieces: list, best: np.ndarray, sure: np.ndarray) -> Iterator[tuple]:
    now = None
    for (k, f, at, s), b, c in zip(pieces, best, sure, strict=True):
        if b < 0:
            continue
        if now and now[0] == k and now[1] == f and now[5] == b:
            now[3], now[4], now[6] = at + len(s) - now[2], now[4] + 1, now[6] + c
            continue
        if now:
            yield (*now[:5], LANGUAGES[now[5]], float(now[6] / now[4]))
        now = [k, f, at, len(s), 1, b, c]
    if now:
        yield (*now[:5], LANGUAGES[now[5]], float(now[6] / now[4]))


def languages(found: DataFrame) -> DataFrame:
    """(key, lang, share, confidence, main) of each language of each key in ``segments``; ``main`` covers most of it.

    Ties go to the language that comes first in the alphabet.
    """
    by = found.groupBy("key", "lang").agg(F.sum("length").alias("length"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"))
    packed = by.groupBy("key").agg(F.sum("length").alias("total"), F.collect_list(F.struct((-F.col("length")).alias("minus"), "lang", "confidence")).alias("all"))
    # At most one entry for each language of the model.
    return packed.select("key", "total", F.array_min("all")["lang"].alias("first"), F.explode("all").alias("x")).select(
        "key", F.col("x.lang").alias("lang"), (-F.col("x.minus") / F.col("total")).alias("share"), F.col("x.confidence").alias("confidence"), (F.col("x.lang") == F.col("first")).alias("main")
    )


def mislabelled(rows: DataFrame, key: str, text: list[str], label: str, model: Model) -> DataFrame:
    """(key, lang, confidence, problem), a row for each language of each record whose label is absent, wrong or not enough.

    ``problem`` is ``missing``, ``wrong`` or ``mixed``, the first that holds. Records in which no language is found give no
    row. ``key`` must be unique.
    """
    found = languages(segments(rows, key, text, model))
    labels = rows.select(F.col(key).alias("key"), label_language(F.col(label)).alias("label"), (F.coalesce(pystrip(label), F.lit("")) == "").alias("blank"))
    main = found.where("main").select("key", F.col("lang").alias("most"), (F.col("share") < 1).alias("mixed"))
    problem = F.when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("most"), "wrong").when(F.col("mixed"), "mixed")
    return found.join(main, "key").join(labels, "key").withColumn("problem", problem).where("problem is not null").select("key", "lang", "confidence", "problem")
