"""Passages of held-out items in a training corpus, whole or in part, with small changes.

Latent semantic retrieval: the passages and questions of the items are cut into windows, weighted by TF-IDF, with document
frequencies counted over the whole corpus, and a distributed randomised SVD of them gives a latent space. Windows of the
corpus are compared with those of the items by cosine in that space, and what comes near is verified word by word: a run
of an item's words in order, with at most one in six changed, dropped or added, in which the words that tell the item
from the rest of the corpus agree. A run that stands in a document word for word needs no such words: it is looked up.

The corpus is read once. A document becomes the numbers of its words in the items' vocabulary, with -1 for any other
word; that loses nothing, as other words match no item. The items are a test set made by hand, so they, their vocabulary
and the latent space are bounded, and a larger set is refused.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.session import durable

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.DOTALL)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Words of a window of the corpus and the step between two; a run of RUN words with two more lies whole in some window.
WINDOW, STEP = 20, 6
#: Words of a run, changes that it may have, and the step between an item's windows.
RUN, CHANGES, ITEM_STEP = 12, 2, 3
#: Words that are taken as an item's own, where a document's words are counted, if they stand in its order.
OWN = RUN - CHANGES
#: A word in so few texts tells, however small the corpus.
LEAST = 3


def words(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, line breaks or differences of encoding."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """The runs of held-out items, as rows of word numbers."""

    vocabulary: dict[str, int]
    runs: np.ndarray  # every run of RUN words
    item: np.ndarray  # the item of each run
    passage: np.ndarray  # the text it is from; runs of one text follow one another
    words_of: dict[int, np.ndarray]  # the words of each item
    answers: np.ndarray  # for each run, which of its words are in the item's answer


def load_items(rows: list) -> Items:
    """The items of rows (key, one or several texts, answer). Texts under RUN words have no runs."""
    vocabulary: dict[str, int] = {}
    runs, item, passage, words_of, answers = [], [], [], {}, []
    for n, (k, *texts, answer) in enumerate(rows):
        said = {w for w in words(answer or "") if len(w) >= 5}
        for j, value in enumerate(texts):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(value or "")]
            words_of[k] = np.union1d(words_of.get(k, []), ids).astype(np.int64)
            meant = {vocabulary[w] for w in said if w in vocabulary}
            for at in range(len(ids) - RUN + 1):
                runs.append(ids[at : at + RUN])
                answers.append([i in meant for i in runs[-1]])
                item.append(k)
                passage.append(n * len(texts) + j)
    return Items(vocabulary, np.array(runs, np.int32).reshape(-1, RUN), np.array(item, np.int64), np.array(passage, np.int64), words_of, np.array(answers, bool).reshape(-1, RUN))


def _hashes(rows: np.ndarray) -> np.ndarray:
    """A number for each row of word numbers, equal for equal rows."""
    total = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        total = total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
    return total


class Lookup:
    """Finds the first ``length`` words of every run of items where they stand in documents word for word."""

    def __init__(self, items: Items, length: int) -> None:
        self.starts, self.item = items.runs[:, :length], items.item
        if length < RUN:  # the last words of a text start no run
            self.starts = np.concatenate([items.runs[:, j : j + length] for j in range(RUN - length + 1)])
            self.item = np.tile(items.item, RUN - length + 1)
            _, one = np.unique(np.column_stack((self.starts, self.item)), axis=0, return_index=True)
            self.starts, self.item = self.starts[one], self.item[one]
        hashes = _hashes(self.starts)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.length = hashes[self.order], length

    def found(self, coded: list[bytes], most: int = 200_000) -> set[tuple[int, int]]:
        """(place in ``coded``, item), looked at in parts of about ``most`` words."""
        out: set[tuple[int, int]] = set()
        part, owners, held = [], [], 0
        for n, raw in enumerate(coded):
            part += [np.frombuffer(raw, np.int32), np.full(1, -1, np.int32)]  # no run goes on across other words
            owners.append((n, len(part[-2]) + 1))
            held += len(part[-2]) + 1
            if held >= most or n == len(coded) - 1:
                out |= self._part(np.concatenate(part), np.repeat(*np.array(owners).T))
                part, owners, held = [], [], 0
        return out

    def _part(self, ids: np.ndarray, owners: np.ndarray) -> set[tuple[int, int]]:
        if len(ids) < self.length:
            return set()
        # A run holds no other words, so only the places are looked up where none stands.
        other = np.cumsum(np.append(0, ids < 0))
        places = np.flatnonzero(other[self.length :] == other[: -self.length])
        rows = np.lib.stride_tricks.sliding_window_view(ids, self.length)[places]
        hashes = _hashes(rows)
        low = np.searchsorted(self.hashes, hashes, "left")
        hit = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes)
        places, rows, low = places[hit], rows[hit], low[hit]
        n = np.searchsorted(self.hashes, hashes[hit], "right") - low
        at = np.repeat(np.arange(len(rows)), n)
        r = self.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(at))]
        same = (self.starts[r] == rows[at]).all(1)
        return set(zip(owners[places[at[same]]].tolist(), self.item[r[same]].tolist(), strict=True))


def encoded(documents: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """(key, ids): the word numbers of each document with a text, four bytes each, of which -1 is another word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "ids": [np.fromiter(map(get, words(t), repeat(-1)), np.int32).tobytes() for t in batch["text"]]})

    kind = documents.schema[key].dataType.simpleString()
    shown = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return shown.mapInPandas(run, f"key {kind}, ids binary")


def frequencies(coded: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray, int]:
    """In how many different texts each word of the vocabulary occurs, apart from the texts that hold an item with that
    word; in how many of those; and how many different texts there are.

    A text counts as holding an item if OWN words of it stand there word for word. So neither the copies of a leaked
    passage nor those of the documents around it make its words common. Texts travel as the numbers of their words, once
    from each task; each task sends one count for each word it saw.
    """
    size, lookup = len(items.vocabulary), Lookup(items, OWN)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("same")
            held: dict[int, list[np.ndarray]] = {}
            for n, item in lookup.found(list(batch["ids"])):
                held.setdefault(n, []).append(items.words_of[item])
            parts = []
            for n, raw in enumerate(batch["ids"]):
                ids = np.unique(np.frombuffer(raw, np.int32))
                ids = ids[ids >= 0]
                own = np.isin(ids, np.concatenate(held[n])) if n in held else np.zeros(len(ids), bool)
                parts.append((ids[~own].tobytes(), ids[own].tobytes()))
            yield pd.DataFrame({"same": batch["same"].to_numpy(), "apart": [p[0] for p in parts], "own": [p[1] for p in parts]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((size + 1, 2), np.int64)
        for batch in batches:
            for j, c in enumerate(("apart", "own")):
                for ids in batch[c]:
                    seen[np.frombuffer(ids, np.int32), j] += 1
            seen[size, 0] += len(batch)
        at = np.nonzero(seen.any(1))[0]
        yield pd.DataFrame({"word": at, "apart": seen[at, 0], "own": seen[at, 1]})

    texts = coded.select(F.xxhash64("ids").alias("same"), "ids").mapInPandas(split, "same bigint, apart binary, own binary")
    one = texts.groupBy("same").agg(F.first("apart").alias("apart"), F.first("own").alias("own")).select("apart", "own")
    counts = np.zeros((size + 1, 2), np.int64)
    for word, *n in one.mapInPandas(run, "word bigint, apart bigint, own bigint").groupBy("word").agg(F.sum("apart"), F.sum("own")).collect():
        counts[word] = n
    return counts[:size, 0], counts[:size, 1], int(counts[size, 0])


def latent_space(items: DataFrame, text: list[str], vocabulary: dict[str, int], idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF windows of the items' texts, words by ``rank``.

    A randomised SVD, distributed over the rows: every task multiplies its windows with the current basis and sends back
    one matrix of that size; the windows themselves stay where they are.
    """
    size = len(vocabulary)
    rank = min(rank, size)
    basis = np.random.default_rng(seed).normal(size=(size, min(size, rank + 16)))

    def partial(basis: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(basis)
            for batch in batches:
                for c in batch.columns:
                    for value in batch[c]:
                        ids = [vocabulary[w] for w in words(value or "")]
                        for at in range(0, max(1, len(ids) - RUN + 1), ITEM_STEP):
                            some = np.array(ids[at : at + RUN], np.int64)
                            if len(some):
                                row = idf[some] @ basis[some]
                                np.add.at(total, some, idf[some][:, None] * row)
            yield pd.DataFrame({"part": [total.tobytes()]})

        return run

    for _ in range(rounds + 1):
        parts = items.select(*text).mapInPandas(partial(basis), "part binary").collect()
        basis = np.linalg.qr(sum((np.frombuffer(p["part"]).reshape(basis.shape) for p in parts), np.zeros_like(basis)))[0]
    return np.ascontiguousarray(basis[:, :rank], np.float32)


def cells_of(vectors: np.ndarray, size: int = 16, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cell of each vector): cells of about ``size`` vectors by k-means on the sphere."""
    picked = np.random.default_rng(seed).permutation(len(vectors))[: max(1, len(vectors) // size)]
    centres = vectors[picked]
    for _ in range(rounds):
        cell = (vectors @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, vectors)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.maximum(length, 1e-9), centres)
    return centres, (vectors @ centres.T).argmax(1)


@dataclass
class Searcher:
    """Finds the runs of items in coded documents."""

    items: Items
    idf: np.ndarray
    space: np.ndarray
    telling: np.ndarray
    cosine: float
    near: float

    def __post_init__(self) -> None:
        size = len(self.items.vocabulary)
        # The last row is for other words and the filling of windows.
        self.weighted = np.zeros((size + 1, self.space.shape[1]), np.float32)
        self.weighted[:size] = self.space * self.idf[:, None]
        self.squared = np.append(self.idf**2, 0).astype(np.float32)
        last = np.append(np.diff(self.items.passage) != 0, True)
        starts = np.nonzero(np.append(True, np.diff(self.items.passage) != 0))[0]
        within = np.arange(len(self.items.runs)) - np.repeat(starts, np.diff(np.append(starts, len(self.items.runs))))
        self.picked = np.nonzero((within % ITEM_STEP == 0) | last)[0]
        runs = self.items.runs[self.picked]
        self.queries = self._latent(runs)
        unit = self.queries / np.maximum(np.linalg.norm(self.queries, axis=1, keepdims=True), 1e-9)
        self.centres, cell = cells_of(unit)
        self.members = [np.nonzero(cell == c)[0] for c in range(len(self.centres))]
        self.telling = np.append(self.telling, False)
        self.lookup = Lookup(self.items, RUN)

    def _latent(self, windows: np.ndarray) -> np.ndarray:
        """The part of each window's TF-IDF vector, taken as of length one, that lies in the latent space."""
        length = np.sqrt(np.maximum(self.squared[windows].sum(1), 1e-9))
        total = np.zeros((len(windows), self.weighted.shape[1]), np.float32)
        for j in range(windows.shape[1]):
            total += self.weighted[windows[:, j]]
        return total / length[:, None]

    def search(self, keys: list, coded: list[bytes], most: int = 20_000) -> list[tuple]:
        """(key, item) of every document that holds a run of an item; windows are looked at ``most`` at a time."""
        found = {(keys[n], item) for n, item in self.lookup.found(coded)}
        rows, owners, held = [], [], 0
        for n, raw in enumerate(coded):
            ids = np.frombuffer(raw, np.int32)
            padded = np.concatenate((ids, np.full(WINDOW, -1, np.int32)))
            for low in range(0, max(1, len(ids) - RUN + STEP), STEP * most):  # a long document in parts
                starts = np.arange(low, min(low + STEP * most, max(1, len(ids) - RUN + STEP)), STEP)
                windows = padded[starts[:, None] + np.arange(WINDOW)]
                # A run with its changes leaves so many words of items in a window.
                windows = windows[(windows >= 0).sum(1) >= RUN - CHANGES]
                rows.append(windows)
                owners.append(np.full(len(windows), n))
                held += len(windows)
                if held >= most:
                    found |= self._judged(np.concatenate(rows), np.concatenate(owners), keys)
                    rows, owners, held = [], [], 0
        if held:
            found |= self._judged(np.concatenate(rows), np.concatenate(owners), keys)
        return sorted(found)

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, query) of a cosine of at least ``cosine`` in the latent space, looked for in the cells near a window."""
        latent = self._latent(windows)
        close = latent @ self.centres.T >= self.near * np.linalg.norm(latent, axis=1, keepdims=True)
        w, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, members in enumerate(self.members):
            some = np.nonzero(close[:, c])[0]
            if len(some) and len(members):
                i, j = np.nonzero(latent[some] @ self.queries[members].T >= self.cosine)
                w.append(some[i])
                q.append(members[j])
        return np.concatenate(w), np.concatenate(q)

    def _judged(self, windows: np.ndarray, owners: np.ndarray, keys: list) -> set[tuple]:
        w, q = self.candidates(windows)
        out: set[tuple] = set()
        for at in range(0, len(w), 50_000):
            # All runs that start before the next picked one of the same text.
            near = self.picked[q[at : at + 50_000]][:, None] + np.arange(1 - ITEM_STEP, ITEM_STEP)
            ok = (near >= 0) & (near < len(self.items.runs))
            near = np.where(ok, near, 0)
            ok &= self.items.passage[near] == self.items.passage[self.picked[q[at : at + 50_000]]][:, None]
            of = np.broadcast_to(w[at : at + 50_000][:, None], near.shape)
            pairs = np.unique(of[ok] * len(self.items.runs) + near[ok])
            for i, j in self._verified(windows, pairs // len(self.items.runs), pairs % len(self.items.runs)):
                out.add((keys[owners[i]], int(self.items.item[j])))
        return out

    def _verified(self, windows: np.ndarray, w: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, int]]:
        runs, texts = self.items.runs[r], windows[w]
        # What a passage says lies in its telling words and the words of its answer: in a paraphrase they must agree. This
        # costs less than the longest common subsequence, so it comes first.
        telling = self.telling[runs] | (self.items.answers[r] & (runs >= 0))
        present = np.zeros(runs.shape, bool)
        for j in range(runs.shape[1]):
            present[:, j] = (texts == runs[:, j, None]).any(1)
        likely = (present.sum(1) >= RUN - CHANGES) & (telling & present).any(1) & ~(telling & ~present).any(1)
        w, r, runs, texts, telling = w[likely], r[likely], runs[likely], texts[likely], telling[likely]
        likely = _common(runs, texts) >= RUN - CHANGES
        w, r, runs, texts, telling = w[likely], r[likely], runs[likely], texts[likely], telling[likely]
        if not len(w):
            return
        changes = _changes(runs, texts)
        # Neighbouring telling words, such as the two of a species' name, say as much as one.
        told = (telling & ~np.pad(telling, ((0, 0), (1, 0)))[:, :-1]).sum(1)
        good = (changes == 0) | ((changes <= CHANGES) & (told >= 2))
        yield from zip(w[good].tolist(), r[good].tolist(), strict=True)


def _common(runs: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each run and its text."""
    last = np.zeros((len(runs), texts.shape[1] + 1), np.int8)
    for i in range(runs.shape[1]):
        row = np.zeros_like(last)
        same = runs[:, i, None] == texts
        for j in range(texts.shape[1]):
            row[:, j + 1] = np.maximum(np.where(same[:, j], last[:, j] + 1, last[:, j + 1]), row[:, j])
        last = row
    return last.max(1)


def _changes(runs: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The fewest words changed, dropped or added that make each run of a stretch of its text."""
    last = np.zeros((len(runs), texts.shape[1] + 1), np.int8)
    for i in range(runs.shape[1]):
        row = np.empty_like(last)
        row[:, 0] = i + 1
        substituted = last[:, :-1] + (runs[:, i, None] != texts)
        dropped = last[:, 1:] + 1
        best = np.minimum(substituted, dropped)
        for j in range(texts.shape[1]):
            row[:, j + 1] = np.minimum(best[:, j], row[:, j] + 1)
        last = row
    return last.min(1)


def leaks(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: list[str], answer: str | None = None,
    rank: int = 256, cosine: float = 0.35, near: float = 0.2, telling_share: float = 0.01, at_once: int = 20_000,
) -> DataFrame:
    """(key, item) of every document that holds a run of an item.

    A run that a document holds word for word is enough. A run with changes must hold two words that tell items from the
    rest and do not stand together, and all telling words of it must agree, and those of the item's ``answer``. A word of
    letters tells if at most ``telling_share`` of the different texts hold it, or most of those that do hold an item with
    that word; texts that hold such an item do not count against it, so that items that leaked widely keep their telling
    words. Null texts give no rows; texts of any length are read whole; every copy of a document is reported; a document may
    hold several items. An empty corpus or an empty test set gives no rows. Other columns, whatever their names, are not read.

    Items are searched for ``at_once`` at a time, which bounds what a worker holds; more of them take more passes.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, item bigint"
    said = F.col(answer) if answer else F.lit(None).cast("string")
    rows = items.select(F.col(item_key).cast("bigint").alias("item"), *item_text, said.alias("said")).where("item is not null")
    parts = -(-rows.count() // at_once)
    found = documents.sparkSession.createDataFrame([], schema)
    for n in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == n)
        found = found.unionByName(_leaks_of(documents, key, text, part, item_text, schema, rank, cosine, near, telling_share))
    return found


def _leaks_of(documents: DataFrame, key: str, text: str, items: DataFrame, item_text: list[str], schema: str, rank: int, cosine: float, near: float, telling_share: float) -> DataFrame:
    loaded = load_items(items.select("item", *item_text, "said").orderBy("item").collect())
    if not len(loaded.runs):
        return documents.sparkSession.createDataFrame([], schema)
    coded = durable(encoded(documents, key, text, loaded.vocabulary))
    counts, own, total = frequencies(coded, loaded)
    idf = np.array([math.log((total + 1) / (c + 1)) + 0.01 for c in counts])
    letters = np.array([w.isalpha() and len(w) >= 5 for w in loaded.vocabulary])
    telling = letters & (counts <= np.maximum(own, max(LEAST, total * telling_share)))
    space = latent_space(items, item_text, loaded.vocabulary, idf, rank)
    searcher = Searcher(loaded, idf.astype(np.float32), space, telling, cosine, near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(searcher.search(list(batch["key"]), list(batch["ids"])), columns=["key", "item"])

    return coded.mapInPandas(run, schema)


def reported(found: DataFrame, items: DataFrame, item_key: str) -> DataFrame:
    """(item, documents) for every item, also those that leaked nowhere."""
    counts = found.groupBy("item").agg(F.count("*").alias("documents"))
    every = items.select(F.col(item_key).alias("item")).where("item is not null").distinct()
    return every.join(counts, "item", "left").select("item", F.coalesce("documents", F.lit(0)).alias("documents"))
