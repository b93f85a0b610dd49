"""Scalar functions whose results follow SQLite where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(x: Column) -> Column:
    """ASCII only."""
    return F.translate(x, _UPPER, _LOWER)


def upper(x: Column) -> Column:
    """ASCII only."""
    return F.translate(x, _LOWER, _UPPER)


def hex_text(x: Column) -> Column:
    """Hexadecimal digits of the text form, of numbers too; binary values keep their bytes."""
    return F.hex(x.cast("string"))


def greatest(*xs: Column) -> Column:
    """Null if any argument is."""
    return F.when(~_any_null(xs), F.greatest(*xs))


def least(*xs: Column) -> Column:
    """Null if any argument is."""
    return F.when(~_any_null(xs), F.least(*xs))


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x.isNull()
    return out


def substr(x: Column, start: int, length: int) -> Column:
    """Positions count from 1; a start of 0 uses up one position before the text."""
    return F.substring(x, 1, max(0, length - 1)) if start == 0 else F.substring(x, start, length)


def divide(a: Column, b: Column) -> Column:
    """Whole numbers divide without remainder, towards zero; by zero null."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def typeof(x: Column) -> Column:
    """null, integer, real, text or blob."""
    kind = F.typeof(x)
    named = F.when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer").when(kind.isin("float", "double"), "real").when(kind == "binary", "blob").otherwise("text")
    return F.when(x.isNull(), "null").otherwise(named)


def round_real(x: Column, digits: int = 0) -> Column:
    """Half away from zero, always a double."""
    return F.round(x.cast("double"), digits)


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))
