"""Prompts for the extraction, and the text they ask about."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip, squeeze

#: Fixed value: what a model is held to if hard constraints are on.
HARD_CONSTRAINTS = (
    "\nHard constraints:\n"
    "1. Only use predefined entity types and predefined relation types from this prompt.\n"
    "2. Output must be a JSON array only; do not add any explanatory text.\n"
)


def template(raw: str) -> str:
    """A prompt file without its own draft of an input section."""
    head, *rest = re.split(r"\n##\s*Input\b", raw, maxsplit=1, flags=re.IGNORECASE)
    return head.rstrip() if rest else raw.strip()


def system_prompt(raw: str, hard: bool = False) -> str:
    return f"{template(raw)}\n{HARD_CONSTRAINTS if hard else ''}"


def user_prompt(text: Column) -> Column:
    return F.concat(F.lit("## Input\n```\n{"), text, F.lit("}\n```\n"))


def input_text(title: Column, abstract: Column) -> Column:
    """Title and abstract as one line; null counts as empty."""
    return squeeze(F.concat(F.coalesce(pystrip(title), F.lit("")), F.lit(" "), F.coalesce(pystrip(abstract), F.lit(""))))
