"""The verbs of pipelines: what each does to a frame, how it prints, and what it needs and lets through.

Names of verbs and the printed form are fixed values; they are what users write and read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, ClassVar

from ..functions.expr import Expression, as_expression
from ..operators.frame import Frame


class Verb:
    """One operation. Verbs know three things that a rewriting may ask: which columns they read, which they must be given
    so that certain columns come out, and whether a row-wise condition on some columns may as well be applied before them."""

    kind: ClassVar[str]

    def on(self, frame: Frame) -> Frame:
        raise NotImplementedError

    def inputs(self) -> list[str]:
        """What is printed between the parentheses."""
        raise NotImplementedError

    def render(self) -> str:
        return f"{self.kind}({', '.join(self.inputs())})"

    __repr__ = __str__ = lambda self: self.render()

    def passes(self, columns: set[str]) -> bool:
        """Whether a condition on columns holds for the same rows before and after."""
        return False

    def needs(self, wanted: list[str]) -> list[str] | None:
        """The columns to be given so that wanted come out, in the order of wanted as far as they pass; None: it cannot be told."""
        return None


class OfNames(Verb):
    def __init__(self, *names: str):
        self.names = names

    def inputs(self) -> list[str]:
        return [repr(n) for n in self.names]


class Select(OfNames):
    kind = "select"

    def on(self, frame: Frame) -> Frame:
        return frame.select(*self.names)

    def passes(self, columns: set[str]) -> bool:
        return columns.issubset(self.names)


class Exclude(OfNames):
    kind = "exclude"

    def on(self, frame: Frame) -> Frame:
        return frame.exclude(*self.names)

    def passes(self, columns: set[str]) -> bool:
        return columns.isdisjoint(self.names)

    def needs(self, wanted: list[str]) -> list[str] | None:
        return wanted if self.passes(set(wanted)) else None


class GroupBy(OfNames):
    kind = "groupby"

    def on(self, frame: Frame) -> Frame:
        return frame.group_by(*self.names)


class Ungroup(OfNames):
    kind = "ungroup"

    def on(self, frame: Frame) -> Frame:
        return frame.ungroup()


class Filter(Verb):
    """A condition on rows; it never changes columns."""

    def __init__(self, predicate: Any):
        self.predicate = predicate
        self.condition = as_expression(predicate)
        self.reads = self.condition.cols_used()

    def inputs(self) -> list[str]:
        return [self.predicate.render() if isinstance(self.predicate, Expression) else repr(self.predicate)]

    def passes(self, columns: set[str]) -> bool:
        return self.condition.is_rowwise()

    def needs(self, wanted: list[str]) -> list[str] | None:
        return wanted + sorted(self.reads.difference(wanted))


class Keep(Filter):
    kind = "keep"

    def on(self, frame: Frame) -> Frame:
        return frame.keep(self.predicate)


class Remove(Filter):
    kind = "remove"

    def on(self, frame: Frame) -> Frame:
        return frame.remove(self.predicate)


class Derive(Verb):
    kind = "derive"

    def __init__(self, **columns: Any):
        self.columns = columns
        self.parsed = {n: as_expression(v) for n, v in columns.items()}

    def on(self, frame: Frame) -> Frame:
        return frame.derive(**self.columns)

    def inputs(self) -> list[str]:
        return [f"{n}={v.render() if isinstance(v, Expression) else v}" for n, v in self.columns.items()]

    @property
    def reads(self) -> set[str]:
        """From the columns given; what an earlier column of the same verb makes is not given."""
        names = list(self.parsed)
        return {r for i, e in enumerate(self.parsed.values()) for r in e.cols_used().difference(names[:i])}

    def passes(self, columns: set[str]) -> bool:
        return columns.isdisjoint(self.columns) and all(e.is_rowwise() for e in self.parsed.values())

    def needs(self, wanted: list[str]) -> list[str] | None:
        old = [n for n in wanted if n not in self.columns]
        return old + sorted(self.reads.difference(old))


class Aggregate(Verb):
    kind = "aggregate"

    def __init__(self, **outputs: tuple[str, Callable] | tuple[str, Callable, str]):
        self.outputs = outputs

    def on(self, frame: Frame) -> Frame:
        return frame.aggregate(**self.outputs)

    def inputs(self) -> list[str]:
        return [f"{n}={v}" for n, v in self.outputs.items()]
