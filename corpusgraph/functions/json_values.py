"""Values of untrusted JSON, read as Python reads them, in Arrow batches.

The JSON functions of the engine differ from Python's parser on ``NaN``, repeated keys, trailing text and the order of
keys, so lines that people or models wrote go through ``json.loads``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a line can be.
OK, BLANK, INVALID, OTHER = "ok", "blank", "invalid", "not_object"

VALUE = T.StructType([T.StructField("present", T.BooleanType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("empty", T.BooleanType())])
_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object", type(None): "null"}


def described(value: object) -> dict:
    """A value that is there: its kind, its text (of a string itself, else its JSON), and whether it counts as empty.

    Null, blank strings and arrays and objects without entries are empty; zero and false are not.
    """
    kind = _KINDS[type(value)]
    text = value if kind == "string" else None if kind == "null" else json.dumps(value, ensure_ascii=False)
    empty = kind == "null" or (kind == "string" and not value.strip()) or (kind in ("array", "object") and not value)
    return {"present": True, "kind": kind, "text": text, "empty": empty}


_ABSENT = {"present": False, "kind": None, "text": None, "empty": True}


def parsed(line: str | None) -> tuple[str, dict]:
    """(status, object) of one line; the object is empty unless the status is ``ok``."""
    if line is None or not line.strip():
        return BLANK, {}
    try:
        value = json.loads(line)
    except ValueError:
        return INVALID, {}
    return (OK, value) if isinstance(value, dict) else (OTHER, {})


def read_object(line: Column, names: list[str]) -> Column:
    """A struct of ``status`` and, for each of ``names``, the described value under that key."""
    schema = T.StructType([T.StructField("status", T.StringType()), *(T.StructField(n, VALUE) for n in names)])

    def batch(lines: pd.Series) -> pd.DataFrame:
        rows = []
        for x in lines:
            status, value = parsed(x)
            rows.append({"status": status} | {n: described(value[n]) if n in value else _ABSENT for n in names})
        return pd.DataFrame(rows, columns=["status", *names])

    return F.pandas_udf(batch, schema)(line)


def rewrite_object(line: Column, change: Callable[[dict], dict]) -> Column:
    """The line with its object changed and written again, other keys kept; null where there is no object."""

    def batch(lines: pd.Series) -> pd.Series:
        out = []
        for x in lines:
            status, value = parsed(x)
            out.append(json.dumps(change(value), ensure_ascii=False) if status == OK else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(batch, T.StringType())(line)


def array_objects(text: Column) -> Column:
    """The objects of a JSON array, as an array of (place, JSON); entries that are no objects are left out.

    Text that is no array gives null.
    """
    entry = T.StructType([T.StructField("place", T.LongType()), T.StructField("value", T.StringType())])

    def one(x: str | None) -> list[dict] | None:
        try:
            value = json.loads(x) if x is not None else None
        except ValueError:
            return None
        if not isinstance(value, list):
            return None
        return [{"place": i, "value": json.dumps(v, ensure_ascii=False)} for i, v in enumerate(value) if isinstance(v, dict)]

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts], dtype=object)

    return F.pandas_udf(batch, T.ArrayType(entry))(text)
