"""Triples out of what a language model answered."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text that is one fenced block, with what stands inside.
_FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.IGNORECASE | re.DOTALL)
#: A string of JSON, also one that never ends, or a bracket outside strings.
_MARK = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[\[\]]', re.DOTALL)

ANSWER = T.StructType([T.StructField("triples", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def unfenced(text: str) -> str:
    text = text.strip()
    block = _FENCED.fullmatch(text)
    return block[1].strip() if block else text


def first_array(text: str) -> str | None:
    """The first balanced array of a text, from its first bracket on; brackets in strings don't count."""
    start, depth = text.find("["), 0
    for mark in _MARK.finditer(text, start) if start >= 0 else ():
        depth += {"[": 1, "]": -1}.get(mark[0], 0)
        if mark[0] == "]" and not depth:
            return text[start : mark.end()]
    return None


def answer_triples(text: str) -> list[dict]:
    """The objects of the array that a model's answer is, or else holds. Raises ValueError if there is none."""
    body = unfenced(text)
    try:
        value = json.loads(body)
    except ValueError:
        inner = first_array(body)
        if inner is None:
            raise
        value = json.loads(inner)
    if not isinstance(value, list):
        raise ValueError("the answer is no JSON array")
    return [v for v in value if isinstance(v, dict)]


def parse_answer(text: Column) -> Column:
    """(triples, error): the JSON of each triple, or why there are none. A null answer is an error."""

    def one(x: str | None) -> dict:
        try:
            return {"triples": [json.dumps(t, ensure_ascii=False) for t in answer_triples(x or "")], "error": None}
        except ValueError as e:
            return {"triples": None, "error": str(e)}

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in texts], columns=["triples", "error"])

    return F.pandas_udf(batch, ANSWER)(text)
