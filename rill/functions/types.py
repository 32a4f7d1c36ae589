"""Column types, missing-value tokens and the inference lattice for text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from enum import StrEnum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataType(StrEnum):
    BOOLEAN = "boolean"
    INT64 = "int64"
    FLOAT64 = "float64"
    STRING = "string"
    CATEGORY = "category"
    ORDINAL = "ordinal"
    DATE = "date"
    DATETIME = "datetime"
    UUID = "uuid"


SPARK = {
    DataType.BOOLEAN: T.BooleanType(),
    DataType.INT64: T.LongType(),
    DataType.FLOAT64: T.DoubleType(),
    DataType.STRING: T.StringType(),
    DataType.CATEGORY: T.StringType(),
    DataType.ORDINAL: T.StringType(),
    DataType.DATE: T.DateType(),
    DataType.DATETIME: T.TimestampNTZType(),
    DataType.UUID: T.StringType(),
}

# Texts that stand for a missing value, and for the two truth values, after trimming, in lower case.
MISSING = ("", "na", "n/a", "null", "none", "nan", ".")
TRUE, FALSE = ("true", "t", "yes", "y"), ("false", "f", "no", "n")
# Whole-text patterns of numbers (ASCII digits).
INTEGER = r"[+-]?[0-9]+"
DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: Types that text is parsed to, the narrowest first.
PARSED = (DataType.BOOLEAN, DataType.INT64, DataType.FLOAT64, DataType.STRING)


def of_spark(kind: T.DataType) -> DataType | None:
    if isinstance(kind, T.BooleanType):
        return DataType.BOOLEAN
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return DataType.INT64
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DataType.FLOAT64
    if isinstance(kind, T.DateType):
        return DataType.DATE
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return DataType.DATETIME
    return None if isinstance(kind, T.NullType) else DataType.STRING


def is_missing(text: str) -> bool:
    return text.strip().lower() in MISSING


def parse_bool(text: str) -> bool | None:
    low = text.lower()
    return True if low in TRUE else False if low in FALSE else None


def parse_int(text: str) -> int | None:
    return int(text) if re.fullmatch(INTEGER, text) else None


def parse_float(text: str) -> float | None:
    return float(text) if re.fullmatch(DECIMAL, text) else None


PARSERS: dict[DataType, Callable[[str], object]] = {
    DataType.BOOLEAN: parse_bool,
    DataType.INT64: parse_int,
    DataType.FLOAT64: parse_float,
    DataType.STRING: lambda s: s,
}


def infer(text: str) -> DataType:
    """The narrowest type that reads the trimmed text."""
    trimmed = text.strip()
    return next(t for t in PARSED if PARSERS[t](trimmed) is not None)


def join(a: DataType, b: DataType) -> DataType:
    """The narrowest type that holds both."""
    if a == b:
        return a
    pair = {a, b}
    if pair == {DataType.INT64, DataType.FLOAT64}:
        return DataType.FLOAT64
    if pair == {DataType.DATE, DataType.DATETIME}:
        return DataType.DATETIME
    return DataType.STRING


def guess(values: Iterable) -> DataType | None:
    """The type that holds every value that is not missing; None if all are. What types occur decides, in any order."""
    texts = {str(v) for v in values if v is not None}
    kinds = {infer(t) for t in texts if not is_missing(t)}
    return reduce(join, sorted(kinds)) if kinds else None


# The same rules as Spark columns.


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def missing_column(text: Column) -> Column:
    return F.lower(trimmed(text)).isin(*MISSING)


def reads_as(text: Column, kind: DataType) -> Column:
    """Whether the whole text, as it stands, is a value of the type."""
    if kind == DataType.BOOLEAN:
        return F.lower(text).isin(*TRUE, *FALSE)
    if kind in (DataType.INT64, DataType.FLOAT64):
        pattern = INTEGER if kind == DataType.INT64 else DECIMAL
        return text.rlike(rf"\A(?:{pattern})\z")
    return F.lit(True)


def parsed(text: Column, kind: DataType) -> Column:
    """The value of a text that reads as the type; null for others."""
    if kind == DataType.BOOLEAN:
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if kind in (DataType.INT64, DataType.FLOAT64):
        return F.when(reads_as(text, kind), text).cast(SPARK[kind])
    return text
