"""A delay-style analysis rebuilt on the order tables: conditions, membership, joins, pivots, filtered aggregates and
quantile flags, with plain SQL logic (three-valued ``&`` and ``|``)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_match(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def any_null(df: DataFrame) -> Column:
    return reduce(Column.__or__, [F.col(f"`{n}`").isNull() for n in df.columns])


def share(condition: Column) -> Column:
    """The share of rows where a condition holds among those where it is not null."""
    return F.avg(condition.cast("int"))


def filtered(value: Column, condition: Column) -> Column:
    """A value where a condition holds, for an aggregate over those rows only."""
    return F.when(condition, value)


def ordered_category(column: Column, levels: list[str]) -> tuple[Column, Column]:
    """A category that must be one of the levels, and its rank among them."""
    known = F.array(*map(F.lit, levels))
    strict = F.when(column.isNull() | column.isin(levels), column).otherwise(F.raise_error(F.lit("no such level")).cast("string"))
    return strict, F.when(column.isNotNull(), F.array_position(known, column))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in df.columns])


def nearest_quantile(df: DataFrame, value: str, q: float, where: Column | None = None, cells: int = 4096) -> Column:
    """The value at position round(q * (n - 1)) in ascending order, as a constant; null without values. Runs jobs."""
    return nearest_quantiles(df, [(value, q, where)], cells)[0]


@dataclass
class Interval:
    """Where a wanted value lies: at a position among the values from low to high, which are whole numbers or finite."""

    value: Column
    whole: bool
    low: object = None
    high: object = None
    place: int = 0

    def part(self, cells: int) -> Column:
        """The number of a value's part of the interval, in ascending order; the ends are in different parts."""
        if self.whole:
            width = max(1, (self.high - self.low) // cells)
            return F.floor((self.value.cast("decimal(20,0)") - F.lit(Decimal(self.low))) / F.lit(Decimal(width))).cast("long")
        half = self.high / 2 - self.low / 2  # the difference itself may be infinite
        scaled = (self.value / 2 - self.low / 2) / (half / cells or half) if half else F.when(self.value > self.low, 1.0).otherwise(0.0)
        return F.floor(F.least(scaled, F.lit(float(cells)))).cast("long")


def nearest_quantiles(df: DataFrame, wanted: list[tuple[str, float, Column | None]], cells: int = 4096) -> list[Column]:
    """nearest_quantile of several (value, q, where), in the same jobs.

    Each job counts the values of the intervals that hold the positions in about ``cells`` equal parts; the part that holds a position
    is its next interval, until that is one value. No values are sorted or gathered, only counts of parts. NaN is no value;
    infinite values are counted apart; whole numbers stay whole."""
    if not wanted:
        return []
    intervals, values = [], []
    for value, _, where in wanted:
        kind = df.schema[value].dataType
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        v = F.col(value).cast("long" if whole else "double")
        v = v if where is None else F.when(where, v)
        v = v if whole else F.when(~F.isnan(v), v)
        intervals.append(Interval(v, whole))
        ends = [F.lit(None).cast("boolean")] * 2 if whole else [v == -math.inf, v == math.inf]
        inner = v if whole else F.when(F.abs(v) != math.inf, v)
        values += [F.count(v), F.count_if(ends[0]), F.count_if(ends[1]), F.min(inner), F.max(inner)]
    found = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(values)]).first())
    done: dict[int, object] = {}
    for i, (x, (_, q, _)) in enumerate(zip(intervals, wanted)):
        n, below, above, x.low, x.high = found[5 * i : 5 * i + 5]
        x.place = int((n - 1) * q + 0.5) - below
        if not n:
            done[i] = None
        elif x.place < 0 or x.place >= n - below - above:
            done[i] = -math.inf if x.place < 0 else math.inf
    while open_ := [i for i, x in enumerate(intervals) if i not in done and x.low < x.high]:
        rows = []
        for i in open_:
            x = intervals[i]
            own = F.struct(
                F.lit(i).alias("i"),
                x.part(cells).alias("part"),
                (x.value if x.whole else F.lit(None)).cast("long").alias("whole"),
                (F.lit(None) if x.whole else x.value).cast("double").alias("real"),
            )
            rows.append(F.when(x.value.between(x.low, x.high), own))
        each = df.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("whole", "real") for f in (F.min, F.max)]
        counts = each.groupBy("i", "part").agg(F.count("*").alias("n"), *ends).collect()  # cells + 1 rows of each, about
        for i in open_:
            x, kind = intervals[i], "whole" if intervals[i].whole else "real"
            for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["part"]):
                if x.place < r["n"]:
                    x.low, x.high = r[f"min_{kind}"], r[f"max_{kind}"]
                    break
                x.place -= r["n"]
    return [F.lit(done.get(i, x.low)).cast("long" if x.whole else "double") for i, x in enumerate(intervals)]


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, levels: list) -> DataFrame:
    """Means of values by index, a column for each level."""
    return df.groupBy(index).pivot(columns, levels).agg(F.avg(values))


def left_lookup(df: DataFrame, table: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """A left join with keys of different names; the right one goes."""
    return df.join(table, df[left_on] == table[right_on], "left").drop(table[right_on])
