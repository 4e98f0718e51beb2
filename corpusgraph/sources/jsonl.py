"""Lines of JSON objects, read strictly, leniently, or with every fault reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.json_values import BLANK, OK, read_object
from corpusgraph.functions.text import pystrip
from corpusgraph.sources.lines import read_lines

MODES = ("strict", "lenient", "diagnostic")


def read_jsonl(spark: SparkSession, paths: list[str], fields: list[str], mode: str = "strict") -> DataFrame:
    """(file, part, line, raw, status, <fields>) of the lines; each field is a described value, see ``json_values``.

    Blank lines are skipped but for ``diagnostic``. ``strict`` fails at a line that is no object, naming its number;
    ``lenient`` leaves it out; ``diagnostic`` keeps it with its status. ``raw`` is the stripped line, byte for byte, so
    keys that nobody asked for can be passed on.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    lines = read_lines(spark, paths).withColumn("raw", pystrip("raw"))
    read = lines.withColumn("__o", read_object(F.col("raw"), fields))
    status = F.col("__o.status")
    if mode == "strict":
        told = F.concat(F.lit("line "), F.col("line"), F.lit(" of "), F.col("file"), F.lit(" is "), status)
        status = F.when(status.isin(OK, BLANK), status).otherwise(F.raise_error(told))
    out = read.select("file", "part", "line", "raw", status.alias("status"), *[F.col(f"__o.{f}").alias(f) for f in fields])
    if mode == "diagnostic":
        return out
    return out.where(F.col("status") == OK)


def texts(read: DataFrame, fields: list[str]) -> DataFrame:
    """``read`` with its described values reduced to their text; null for absent and null ones."""
    return read.withColumns({f: F.col(f"{f}.text") for f in fields})


def line_counts(diagnosed: DataFrame) -> DataFrame:
    """(status, lines): how many lines were of which kind."""
    return diagnosed.groupBy("status").agg(F.count("*").alias("lines"))
