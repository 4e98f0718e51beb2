"""Text columns with the white-space rules of Python, evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's ``str.isspace`` accepts; none lies above U+3000.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _ranges(characters: str) -> str:
    """A regular expression's class of the characters, neighbours as ranges, so that a character meets few tests."""
    out: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:04X}}}" + (f"-\\x{{{b:04X}}}" if b > a else "") for a, b in out) + "]"


#: The same set as a class of Java and RE2.
WHITE_CLASS = _ranges(WHITE_SPACE)


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def pystrip(column: Column | str) -> Column:
    """``str.strip()``: white space of any sort off both ends; null stays null."""
    return F.btrim(_c(column), F.lit(WHITE_SPACE))


def is_blank(column: Column | str) -> Column:
    """True for null, empty and all-white values."""
    return F.coalesce(pystrip(column) == "", F.lit(True))


def squeeze(column: Column | str) -> Column:
    """Stripped, with every run of white space made one space."""
    return pystrip(F.regexp_replace(_c(column), f"{WHITE_CLASS}+", " "))


def pmid_number(column: Column | str) -> Column:
    """The number a PMID names, however it is written (``PMID: 0123``, padded, with leading zeros); null if none.

    A value that holds anything besides an optional ``pmid`` prefix and ASCII digits names no number.
    """
    digits = F.regexp_extract(F.lower(pystrip(column)), r"^(?:pmid)?[\s:#=]*0*([0-9]{1,18})$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def text_or_none(mode: str, column: Column | str) -> Column:
    """A key as text under one of three null rules.

    ``empty``: null gives ''. ``null``: null and blank give null. ``literal``: null gives the text ``None``.
    """
    value = pystrip(_c(column).cast("string"))
    if mode == "empty":
        return F.coalesce(value, F.lit(""))
    if mode == "null":
        return F.nullif(value, F.lit(""))
    if mode == "literal":
        return F.coalesce(value, F.lit("None"))
    raise ValueError(f"mode {mode!r} is none of empty, null, literal")


def sql_strip(column: str) -> str:
    """``pystrip`` as a SQL expression."""
    return f"trim({column}, {' || '.join(f'chr({ord(c)})' for c in WHITE_SPACE)})"
