"""The vocabularies of entity types and relations out of a prompt, and the rules for relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.functions.text import pystrip

#: Headings of the sections and the row of a table.
ENTITIES, RELATIONS, OUTPUT = "## Predefined Entity Types", "## Predefined Relation Types", "## Output Format"
_ROW = re.compile(r"\|\s*`([^`]+)`\s*\|")


def _rows(lines: list[str], strip: bool) -> list[str]:
    found = [m[1] for line in lines if (m := _ROW.match(line.strip() if strip else line))]
    return sorted({f.strip() if strip else f for f in found})


def vocabularies(prompt: str) -> dict[str, list[str]]:
    """Both vocabularies: headings may stand anywhere in a line, and the relations end at the output format.

    A missing heading or an empty table is an error.
    """
    lines, places = prompt.splitlines(), []
    for heading in (ENTITIES, RELATIONS, OUTPUT):
        at = next((i for i, line in enumerate(lines) if heading in line), None)
        if at is None:
            raise ValueError(f"the prompt lacks the section {heading}")
        places.append(at)
    found = {"entity_type": _rows(lines[places[0] : places[1]], False), "relation": _rows(lines[places[1] : places[2]], False)}
    for kind, terms in found.items():
        if not terms:
            raise ValueError(f"the prompt defines no {kind}")
    return found


def relations(prompt: str) -> list[str]:
    """The relations only: their heading fills a line, and they end at the next heading of its level. There may be none."""
    lines = [line.strip() for line in prompt.splitlines()]
    if RELATIONS not in lines:
        return []
    body = lines[lines.index(RELATIONS) + 1 :]
    end = next((i for i, line in enumerate(body) if line.startswith("## ")), len(body))
    return _rows(body[:end], True)


def vocabulary_table(spark: SparkSession, prompt: str) -> DataFrame:
    """(kind, term) of a prompt."""
    return spark.createDataFrame([(k, t) for k, terms in vocabularies(prompt).items() for t in terms], "kind string, term string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a CSV file with a header; a byte-order mark is dropped, further columns are ignored."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path)
    names = {c: c.lstrip("\ufeff").strip() for c in rows.columns}
    return rows.select(*[pystrip(f"`{c}`").alias(n) for c, n in names.items()])
