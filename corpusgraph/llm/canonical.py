"""Mapping of freely written values to the closest entry of a reference list.

Distinct values are taken first, so the cost of scoring follows the number of different spellings, not of rows. Each is
normalised, its candidates are retrieved through an inverted index of character n-grams over the spellings of the list
(terms, the other names their notes give, and both with one slip of the pen), scored by weighted cosine, and accepted above
a threshold and a margin to the best candidate of another term. What is left is reported as unmatched. The threshold is
calibrated on the list itself: spellings with two slips must pass, and terms that the list would lack must not.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import is_blank
from corpusgraph.operators.routing import TYPE_NAMES

UNMATCHED = "unmatched"

#: Words that turn a statement into its opposite, or deny it.
NEGATIONS = frozenset("not no non never without lacks lack absent independent unaffected uncorrelated unrelated neither nor cannot".split())
#: Label prefixes and trailing remarks around a value.
_PREFIX = re.compile(r"^(?:type|entity|relation|label|value|class)\s*[=:]\s*")
_REMARK = re.compile(r"(?:\s*[(\[][^()\[\]]*[)\]])+$")
_INITIALS = re.compile(r"(?<![^_])[a-z](?:_[a-z])+(?![^_])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]{2})")


def normalise(value: str) -> str:
    """Compatibility forms unified, marks of no width, quotes, brackets, remarks and label prefixes gone, words by ``_``."""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").strip()
    text = _PREFIX.sub("", text)
    shorter = _REMARK.sub("", text)
    text = shorter or text
    if not text.isupper():
        text = _CAMEL.sub("_", text)
    words = "_".join(re.findall(r"[^\W_]+", text.lower()))
    return _INITIALS.sub(lambda m: m[0].replace("_", ""), words)


def grams(text: str) -> Counter:
    """Runs of two and of three characters, with both ends marked."""
    padded = f"^{text.replace('_', ' ')}$"
    return Counter(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))


def slips(text: str) -> list[str]:
    """The text with one character dropped, doubled, or swapped with the next; none of three characters or fewer, of which
    a slip makes another word."""
    if len(text) <= 3:
        return []
    out = {text[:i] + text[i + 1 :] for i in range(len(text))} | {text[:i] + text[i] + text[i:] for i in range(len(text))}
    out |= {text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1)}
    return sorted(out - {text, ""})


def turned(spelling: str) -> list[str]:
    """The two words of a name the other way round, as in ``type of cell``."""
    words = spelling.split("_")
    return [f"{words[1]}_of_{words[0]}"] if len(words) == 2 and len(words[1]) > 3 else []


class Index:
    """The spellings of a reference list, as they are, with a slip and turned round, behind an inverted index of their n-grams."""

    def __init__(self, spellings: dict[str, str]) -> None:
        self.spellings = spellings
        self.terms = sorted(set(spellings.values()))
        place = {t: i for i, t in enumerate(self.terms)}
        found = Counter(g for s in spellings for g in grams(s))
        self.weight = {g: math.log(1 + len(spellings) / c) for g, c in found.items()}
        self.unseen = math.log(1 + len(spellings))
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        owners: list[int] = []
        for spelling, term in spellings.items():
            for form in (spelling, *slips(spelling), *turned(spelling)):
                gs = grams(form)
                norm = self.norm(gs)
                for g, c in gs.items():
                    lists[g].append((len(owners), c * self.weight.get(g, self.unseen) / norm))
                owners.append(place[term])
        self.owners = np.array(owners, np.int64)
        self.postings = {g: (np.array([i for i, _ in p], np.int64), np.array([w for _, w in p])) for g, p in lists.items()}

    def norm(self, gs: Counter) -> float:
        return math.sqrt(sum((c * self.weight.get(g, self.unseen)) ** 2 for g, c in gs.items()))

    def scores(self, text: str) -> np.ndarray:
        """The weighted cosine of each term's best form with a normalised value."""
        gs = grams(text)
        norm = self.norm(gs)
        met = [(*self.postings[g], c * self.weight.get(g, self.unseen) / norm) for g, c in gs.items() if g in self.postings]
        best = np.zeros(len(self.terms))
        if met:
            forms = np.bincount(np.concatenate([i for i, _, _ in met]), np.concatenate([w * x for _, w, x in met]), len(self.owners))
            np.maximum.at(best, self.owners, forms)
        return best

    def calibrated(self) -> float:
        """The threshold that best parts misspellings of terms from terms that the list would lack.

        The former are spellings with two slips and their own term's score, the latter spellings and the best score of
        another term. Of thresholds that err within two hundredths of the fewest errors, the lowest.
        """
        own, other = [], []
        for n, (spelling, term) in enumerate(self.spellings.items()):
            at = self.terms.index(term)
            once = slips(spelling)
            for i in range(n % 7, len(once), 7):
                twice = slips(once[i])
                if twice:
                    own.append(self.scores(twice[(i * 5 + n) % len(twice)])[at])
            other.append(max(np.delete(self.scores(spelling), at), default=0.0))
        if not own:
            return 1.0
        cuts = np.unique(np.concatenate((own, other)))
        errors = [np.mean(np.array(own) < c) + np.mean(np.array(other) >= c) for c in cuts]
        return float(cuts[np.nonzero(np.array(errors) <= min(errors) + 0.02)[0][0]])


class Matcher:
    """Accepts the closest term of one kind, or none."""

    def __init__(self, index: Index, threshold: float | None = None, margin: float = 0.03) -> None:
        self.index, self.margin = index, margin
        self.threshold = index.calibrated() if threshold is None else threshold

    def closest(self, value: str) -> list[tuple[float, str]]:
        """Up to two pairs (score, term) that score highest, ties by name; none for what can mean no term."""
        text = normalise(value)
        if not text or NEGATIONS & set(text.split("_")) or not self.index.terms:
            return []
        if text in self.index.spellings:
            return [(1.0, self.index.spellings[text])]
        scores = self.index.scores(text)
        best = sorted(np.argpartition(-scores, min(2, len(scores) - 1))[:2].tolist(), key=lambda i: (-scores[i], i))
        return [(float(min(scores[i], 0.999)), self.index.terms[i]) for i in best if scores[i] > 0]

    def match(self, value: str) -> tuple[str, float]:
        """(term or ``unmatched``, score). A tie between terms is no match."""
        best = self.closest(value)
        if not best:
            return UNMATCHED, 0.0
        clear = best[0][0] >= self.threshold and (len(best) < 2 or best[0][0] - best[1][0] >= self.margin)
        return best[0][1] if clear else UNMATCHED, best[0][0]


def spellings(terms: list[tuple[str, str | None]]) -> dict[str, str]:
    """Normalised spelling -> term: the terms and the other names a note lists after ``also``; a term's own name wins.
    Names that earlier runs gave some entity types belong to the terms that replaced them."""
    out: dict[str, str] = {}
    for term, note in terms:
        for other in re.split(r"[,;]", note.partition("also ")[2]) if note and "also " in note else []:
            if normalise(other):
                out.setdefault(normalise(other), term)
    names = {term for term, _ in terms}
    out |= {normalise(old): term for old, term in TYPE_NAMES.items() if term in names and normalise(old) not in out}
    return out | {normalise(term): term for term in sorted(names, reverse=True) if normalise(term)}


def matchers(reference: DataFrame, kind: str = "kind", term: str = "term", note: str = "note", **limits: float) -> dict[str, Matcher]:
    """A matcher for each kind of a reference list. The list is a dictionary made by hand, so it is held in memory."""
    by_kind: dict[str, list[tuple[str, str | None]]] = defaultdict(list)
    for k, t, n in reference.select(F.col(kind), F.col(term), F.col(note)).where(F.col(kind).isNotNull() & F.col(term).isNotNull()).orderBy(kind, term, note).collect():
        by_kind[k].append((t, n))
    return {k: Matcher(Index(spellings(v)), **limits) for k, v in by_kind.items()}


def distinct_values(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, value) of every value of the columns in ``kinds`` (column -> kind) that is neither null nor blank."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in kinds.items()]))
    return rows.select(pairs.alias("p")).select("p.*").where(~is_blank("value")).distinct()


def map_values(values: DataFrame, by_kind: dict[str, Matcher]) -> DataFrame:
    """(kind, value, term, score) for each row of (kind, value); a kind without a list is unmatched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [by_kind[k].match(v) if k in by_kind else (UNMATCHED, 0.0) for k, v in zip(batch["kind"], batch["value"], strict=True)]
            yield batch[["kind", "value"]].assign(term=[t for t, _ in found], score=[float(s) for _, s in found])

    # A number of its own, so that few values are still spread over all cores.
    spread = values.select("kind", "value").repartition(values.sparkSession.sparkContext.defaultParallelism * 2, "value")
    return spread.mapInPandas(run, "kind string, value string, term string, score double")


def canonical_rows(rows: DataFrame, key: str, reference: DataFrame, kinds: dict[str, str], **limits: float) -> DataFrame:
    """(key, field, value, term, score) of every value that is not, character for character, a term of its kind.

    ``kinds`` maps a column of ``rows`` to the kind of term it should hold. Null and blank values give no row. Equal rows
    give equal results, one for each row. Values equal to a term are dropped before any shuffle; the rest meet their
    scores in a join on the value, whose scored side holds each spelling once, so that a spelling which fills a third of
    the rows is split by the skew handling of the join. Other columns, whatever their names, are not read. An empty table
    gives no rows; an empty list makes every value unmatched.
    """
    by_kind = matchers(reference, **limits)
    exact = {k: sorted(set(m.index.spellings.values())) for k, m in by_kind.items()}
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in kinds.items()]))
    odd = rows.select(F.col(key).alias("key"), fields.alias("f")).select("key", "f.*").where(~is_blank("value"))
    for kind, terms in exact.items():
        odd = odd.where(~((F.col("kind") == kind) & F.col("value").isin(terms)))
    scored = map_values(odd.select("kind", "value").distinct(), by_kind)
    return odd.join(scored, ["kind", "value"]).select(F.col("key").alias(key), "field", "value", "term", "score")
