"""Article records out of the XML of a literature service."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.sources.json_arrays import ARTICLE

SCHEMA = ", ".join(f"{f} string" for f in ARTICLE)


def _inner(node: ET.Element | None) -> str:
    """All text under a node, inline markup dropped, stripped; '' without a node."""
    return "" if node is None else "".join(node.itertext()).strip()


def _joined(parts: Iterable[str], by: str) -> str:
    return by.join(p for p in parts if p)


def _date(article: ET.Element) -> str:
    at = article.find(".//Journal/JournalIssue/PubDate")
    if at is None:
        return ""
    return _inner(at.find("MedlineDate")) or _joined((_inner(at.find(part)) for part in ("Year", "Month", "Day")), "-")


def _author(node: ET.Element) -> str:
    group, family = _inner(node.find("CollectiveName")), _inner(node.find("LastName"))
    given = _inner(node.find("ForeName")) or _inner(node.find("Initials"))
    return group or (f"{family} {given}".strip() if family else "")


def _labelled(node: ET.Element) -> str:
    label = node.get("Label")
    return f"{label}: {_inner(node)}" if label else _inner(node)


def _ids(article: ET.Element, nested: bool) -> dict[str, str]:
    """The last identifier of each type: the article's own, or with ``nested`` those of its references, too."""
    own = ".//ArticleIdList/ArticleId" if nested else "./PubmedData/ArticleIdList/ArticleId"
    return {node.get("IdType", "").lower(): (node.text or "").strip() for node in article.iterfind(own)}


def parse_articles(xml: str, nested_ids: bool = False) -> list[dict[str, str]]:
    """The articles of a document that have a PMID, every field as text, '' if absent. A broken document has none.

    Identifiers are the article's own; ``nested_ids`` takes those of its references as well, of which the last wins.
    """
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for article in root.iter("PubmedArticle"):
        ids = _ids(article, nested_ids)
        values = (
            _inner(article.find(".//PMID")),
            ids.get("pmc", ""),
            ids.get("doi", ""),
            _inner(article.find(".//Journal/Title")) or _inner(article.find(".//Journal/ISOAbbreviation")),
            _joined(map(_inner, article.iterfind(".//PublicationTypeList/PublicationType")), "; "),
            _date(article),
            _joined(map(_author, article.iterfind(".//AuthorList/Author")), "; "),
            _inner(article.find(".//ArticleTitle")),
            " ".join(map(_labelled, article.iterfind(".//AbstractText"))).strip(),
        )
        if values[0]:
            out.append(dict(zip(ARTICLE, values, strict=True)))
    return out


def articles(documents: DataFrame, xml: str = "value", nested_ids: bool = False) -> DataFrame:
    """The articles of all documents; nothing is shuffled. Null and broken documents give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [a for x in batch["xml"] for a in parse_articles(x, nested_ids)]
            yield pd.DataFrame(rows, columns=list(ARTICLE))

    return documents.select(F.col(xml).alias("xml")).where("xml is not null").mapInPandas(run, SCHEMA)
