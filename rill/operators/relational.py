"""What Spark offers beyond the verbs: joins of any kind, sets of rows, first rows, subtotals, SQL. All lazy; groups are cleared."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import functions as F

from ..functions.expr import Scope, quoted
from ..functions.kernels import aggregate_column
from .frame import Frame, session

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: Frame, right: Frame, on: str | Sequence[str] | Mapping[str, str], how: str = "inner") -> Frame:
    """left's columns and right's but the keys, which go by left's names (``on`` may map left's names to right's). Missing keys match
    nothing; in a right or full join a key is whichever side has it. Other names that both have are an error."""
    if how not in JOINS:
        raise ValueError(f"no such join: {how}")
    pairs = {on: on} if isinstance(on, str) else dict(on) if isinstance(on, Mapping) else {n: n for n in on}
    left.check(*pairs)
    right.check(*pairs.values())
    renamed = {r: n for n, r in pairs.items() if r != n}
    rest = [n for n in right.colnames() if n not in pairs.values()]
    clash = set(rest) & set(left.colnames())
    if clash and how not in ("semi", "anti"):
        raise ValueError(f"both frames have {', '.join(sorted(clash))}")
    other = right.sdf.select(*[F.col(quoted(r)).alias(renamed.get(r, r)) for r in [*pairs.values(), *(rest if how not in ("semi", "anti") else [])]])
    joined = left.sdf.join(other, list(pairs), JOINS[how])
    return Frame(joined.select(*[quoted(n) for n in [*left.colnames(), *(rest if how not in ("semi", "anti") else [])]]))


def distinct(frame: Frame) -> Frame:
    """Each different row once."""
    return Frame(frame.sdf.distinct())


def _aligned(a: Frame, b: Frame):
    if sorted(a.colnames()) != sorted(b.colnames()):
        raise ValueError("the frames have different columns")
    return b.sdf.select(*map(quoted, a.colnames()))


def union(a: Frame, b: Frame) -> Frame:
    """All rows of both, columns by name."""
    return Frame(a.sdf.union(_aligned(a, b)))


def intersect(a: Frame, b: Frame) -> Frame:
    """The different rows that both have; missing values are equal."""
    return Frame(a.sdf.intersect(_aligned(a, b)))


def subtract(a: Frame, b: Frame) -> Frame:
    """The different rows of a that b has not; missing values are equal."""
    return Frame(a.sdf.subtract(_aligned(a, b)))


def top(frame: Frame, n: int, *by: str, ascending: bool = False) -> Frame:
    """The first n rows in the order of some columns, missing values last: a heap of n rows a partition, no full sort."""
    frame.check(*by)
    order = [F.col(quoted(c)).asc_nulls_last() if ascending else F.col(quoted(c)).desc_nulls_last() for c in by]
    return Frame(frame.sdf.orderBy(*order).limit(n))


def _subtotals(kind: str) -> Callable[..., Frame]:
    def run(frame: Frame, keys: Sequence[str], **outputs: tuple) -> Frame:
        frame.check(*keys, *[o[0] for o in outputs.values()])
        scope = Scope(frame.sdf)
        columns = [aggregate_column(f, scope.ref(source), *more)[0].alias(name) for name, (source, f, *more) in outputs.items()]
        grouped = getattr(frame.sdf, kind)(*[F.col(quoted(k)) for k in keys])
        return Frame(grouped.agg(*columns, F.grouping_id().cast("long").alias("level")))

    run.__name__ = kind
    run.__doc__ = f"Aggregates by the {kind} of some keys; ``level`` tells which keys a row is summed over (a bit each, the last key lowest)."
    return run


rollup, cube = _subtotals("rollup"), _subtotals("cube")


def sql(text: str, **frames: Frame) -> Frame:
    """A query over frames that it names in braces: sql("SELECT * FROM {orders}", orders=f)."""
    return Frame(session().sql(text, **{name: f.sdf for name, f in frames.items()}))
