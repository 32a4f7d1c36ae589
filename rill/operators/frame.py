"""Immutable frames: a thin wrapper around a Spark DataFrame with grouping keys.

Names are exact: they are checked against the frame's columns, never resolved without regard to case. Nothing runs until
values are asked for, except where a docstring says so. Rows have positions only in the order of the source: of a list,
or of a file's partitions; positional operations number the rows when they are called.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..functions.expr import Expression, Scope, quoted
from ..functions.kernels import aggregate_column
from ..functions.types import PARSED, SPARK, DataType, missing_column, of_spark, parsed, reads_as
from .column import Column, exact
from .storage import fixed

ORDINAL, GROUP = "__row", "__group"
#: Positions that are looked up from the start on, and the longest list that is sent to all tasks.
NEAR, SENT = 10_000, 500_000


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Frame:
    def __init__(self, sdf: SparkFrame, keys: tuple[str, ...] | None = None, snapshot: tuple[str, ...] = (), reduced: bool = False):
        """keys: of the grouping; snapshot: hidden columns that hold the keys as they were when grouped; reduced: whether the plan
        holds a reduction of a whole column, which is a copy of the plan up to there."""
        self._sdf, self.keys, self._snapshot, self._reduced = sdf, keys, snapshot, reduced
        names = self.colnames()
        if len({n.lower() for n in names}) < len(names) and sdf.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
            raise ValueError("names that differ in case only need spark.sql.caseSensitive")

    # Construction

    @staticmethod
    def from_columns(columns: dict[str, Column]) -> Frame:
        if not columns:
            raise ValueError("a frame needs a column")
        if len({len(x) for x in columns.values()}) > 1:
            raise ValueError("columns differ in length")
        for name, x in columns.items():
            if not isinstance(x, Column):
                raise TypeError(f"{name} is no column")
        schema = T.StructType([T.StructField(n, SPARK[x.data_type] if x.data_type else T.NullType()) for n, x in columns.items()])
        return Frame(session().createDataFrame(list(zip(*columns.values())), schema))

    @staticmethod
    def from_list(data: list[list], colnames: list[str] | None = None) -> Frame:
        """From columns as lists; names are x_0, x_1, … unless given."""
        names = [f"x_{i}" for i in range(len(data))] if colnames is None else list(colnames)
        if len(names) != len(data):
            raise ValueError("as many names as columns are needed")
        return Frame.from_columns({n: Column.from_list(v) for n, v in zip(names, data)})

    # Access

    @property
    def sdf(self) -> SparkFrame:
        """The visible columns as a Spark DataFrame."""
        return self._sdf.drop(*self._snapshot) if self._snapshot else self._sdf

    @property
    def groups(self) -> dict:
        return {} if self.keys is None else {"keys": self.keys}

    @property
    def schema(self) -> tuple[DataType | None, ...]:
        return tuple(of_spark(self._sdf.schema[n].dataType) for n in self.colnames())

    def colnames(self) -> list[str]:
        return [n for n in self._sdf.columns if n not in self._snapshot]

    def dims(self) -> tuple[int, int]:
        """(columns, rows); counts once."""
        if not hasattr(self, "_rows"):
            self._rows = self._sdf.count()
        return len(self.colnames()), self._rows

    def validate(self) -> bool:
        names = self.colnames()
        if len(set(names)) < len(names):
            raise ValueError("names repeat")
        return True

    def check(self, *names: str) -> None:
        for n in names:
            if n not in self.colnames():
                raise KeyError(n)

    def col_idxs(self, names: Iterable[str]) -> list[int]:
        names = list(names)
        self.check(*names)
        return [self.colnames().index(n) for n in names]

    def col_name(self, i: int) -> str:
        if not 0 <= i < len(self.colnames()):
            raise IndexError(i)
        return self.colnames()[i]

    def _named(self, key: str | int) -> str:
        name = self.col_name(key) if isinstance(key, int) else key
        self.check(name)
        return name

    def col(self, key: str | int) -> Frame:
        """One column as a lazy frame."""
        return Frame(self._sdf.select(quoted(self._named(key))))

    def get_col(self, key: str | int) -> Column:
        """One column's values; collects them."""
        name = self._named(key)
        kind = self.schema[self.colnames().index(name)]
        return Column(tuple(r[0] for r in self._sdf.select(quoted(name)).collect()), kind)

    def get_value(self, col: str | int, row: int) -> Any:
        """One cell; runs a job."""
        if row < 0:
            raise IndexError(row)
        name = quoted(self._named(col))
        # Near the start partitions are read in order until the row comes; further on it is found in all at once.
        found = self._sdf.select(name).offset(row).head(1) if row < NEAR else self._numbered().where(F.col(ORDINAL) == row).select(name).head(1)
        if not found:
            raise IndexError(row)
        return found[0][0]

    def __getitem__(self, key):
        if isinstance(key, slice):
            return self.slice(key.start, key.stop)
        return self.get_col(key)

    def show(self, n: int = 10) -> None:
        self.sdf.show(n)

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{n}: {t}' for n, t in zip(self.colnames(), self.schema))})"

    # Edits

    def _with(self, sdf: SparkFrame, keep_groups: bool = True) -> Frame:
        if keep_groups:
            return Frame(sdf, self.keys, self._snapshot, self._reduced)
        return Frame(sdf.drop(*self._snapshot) if self._snapshot else sdf, reduced=self._reduced)

    def _scope(self) -> Scope:
        return Scope(self._sdf, self._reduced)

    def _put(self, name: str, column: SparkColumn) -> SparkFrame:
        """Replaces a column in its place or appends it."""
        if name in self.colnames():
            return self._sdf.select(*[column.alias(n) if n == name else F.col(quoted(n)) for n in self._sdf.columns])
        return self._sdf.select(*[F.col(quoted(n)) for n in self._sdf.columns], column.alias(name))

    def set_col(self, name: str, values: Any, data_type: DataType | None = None) -> Frame:
        """A constant, an expression, or a list of as many values as rows: jobs number the rows, and the list, which is the driver's, goes to them."""
        if isinstance(values, Column) or isinstance(values, (list, tuple)) or getattr(values, "ndim", 0):
            own = values if isinstance(values, Column) and data_type is None else Column.from_list(list(values), data_type)
            if len(own) != self.dims()[1]:
                raise ValueError("as many values as rows are needed")
            kind = SPARK[own.data_type] if own.data_type else T.StringType()
            new = "__new"
            schema = T.StructType([T.StructField(ORDINAL, T.LongType()), T.StructField(new, kind)])
            table = self._sdf.sparkSession.createDataFrame(list(enumerate(own)), schema)
            if len(own) <= SENT:  # rows stay where they are, in their order
                joined = self._with(self._numbered().join(F.broadcast(table), ORDINAL))
                return self._with(joined._put(name, F.col(new)).drop(ORDINAL, new))
            joined = self._with(self._numbered().join(table, ORDINAL))
            return self._with(joined._put(name, F.col(new)).orderBy(ORDINAL).drop(ORDINAL, new))
        if isinstance(values, Expression):
            scope = self._scope()
            return self._after(self._put(name, values.typed(scope).column), scope, keep_groups=True)
        one = Column.from_list([values], data_type)
        kind = SPARK[one.data_type] if one.data_type else T.StringType()
        return self._with(self._put(name, F.lit(one[0]).cast(kind)))

    @staticmethod
    def fill_col(value: Any, length: int, data_type: DataType | None = None) -> Column:
        return Column.constant(value, length, data_type)

    def set_value(self, col: str | int, row: int, value: Any) -> Frame:
        """One cell; None makes it missing. Values that the type cannot hold exactly are refused. Runs a job."""
        name = self._named(col)
        if not 0 <= row < self.dims()[1]:
            raise IndexError(row)
        kind = self.schema[self.colnames().index(name)]
        new = F.lit(None if value is None else exact(value, kind)).cast(self._sdf.schema[name].dataType)
        numbered = self._with(self._numbered())
        changed = F.when(F.col(ORDINAL) == row, new).otherwise(F.col(quoted(name)))
        return self._with(numbered._put(name, changed).drop(ORDINAL))

    def drop_col(self, name: str) -> Frame:
        self.check(name)
        if len(self.colnames()) == 1:
            raise ValueError("a frame needs a column")
        return self._with(self._sdf.select(*[quoted(n) for n in self._sdf.columns if n != name]))

    def rename_col(self, old: str, new: str) -> Frame:
        self.check(old)
        if new in self.colnames():
            raise KeyError(new)
        sdf = self._sdf.select(*[F.col(quoted(n)).alias(new) if n == old else F.col(quoted(n)) for n in self._sdf.columns])
        keys = None if self.keys is None else tuple(new if k == old else k for k in self.keys)
        return Frame(sdf, keys, self._snapshot, self._reduced)

    def retype_col(self, name: str, data_type: DataType) -> Frame:
        """A strict change of type by way of text: what does not read exactly as the type fails when it runs."""
        self.check(name)
        kind = DataType(data_type)
        if kind not in PARSED:
            raise KeyError(kind)
        own, x = of_spark(self._sdf.schema[name].dataType), F.col(quoted(name))
        text = x if own == DataType.STRING else as_text(x, own)
        failed = F.raise_error(F.concat(F.lit(f"not {kind}: "), text)).cast(SPARK[kind])
        value = F.when(text.isNull() | missing_column(text), None).when(reads_as(text, kind), parsed(text, kind)).otherwise(failed)
        return self._with(self._put(name, value.cast(SPARK[kind])))

    # Positions

    def _numbered(self) -> SparkFrame:
        """Adds each row's position. Rows are fixed first, in the shared folder, with ids within partitions; the counts of earlier
        partitions, a row for each partition, are joined to them by broadcast."""
        tagged = fixed(self._sdf.withColumn("__id", F.monotonically_increasing_id()))
        tagged = tagged.withColumn("__part", F.shiftright("__id", 33))
        counts = tagged.groupBy("__part").count().orderBy("__part").collect()
        before = itertools.accumulate([0, *[r["count"] for r in counts]])
        starts = tagged.sparkSession.createDataFrame([(r["__part"], b) for r, b in zip(counts, before)], "__part bigint, __before bigint")
        row = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__before")
        return tagged.join(F.broadcast(starts), "__part").withColumn(ORDINAL, row.cast("long")).drop("__id", "__part", "__before")

    def slice(self, start: int | None = None, stop: int | None = None) -> Frame:
        """Rows from start to before stop, clamped; clears groups. With a stop no more than that many rows of a partition are read."""
        first = max(start or 0, 0)
        if stop is not None:
            rows = self._sdf.limit(max(stop, 0)).offset(first)
        else:
            rows = self._numbered().where(F.col(ORDINAL) >= first).drop(ORDINAL) if first else self._sdf
        return self._with(rows, keep_groups=False)

    # Relational operations (the verbs of pipelines)

    def select(self, *names: str) -> Frame:
        if not names:
            raise ValueError("select needs a column")
        self.check(*names)
        return Frame(self._sdf.select(*[quoted(n) for n in dict.fromkeys(names)]), reduced=self._reduced)

    def exclude(self, *names: str) -> Frame:
        rest = [n for n in self.colnames() if n not in names]
        if not rest:
            raise ValueError("a frame needs a column")
        return Frame(self._sdf.select(*map(quoted, rest)), reduced=self._reduced)

    def _after(self, sdf: SparkFrame, scope: Scope, keep_groups: bool) -> Frame:
        out = self._with(sdf, keep_groups)
        out._reduced = self._reduced or scope.embedded
        return out

    def keep(self, predicate: Any) -> Frame:
        """Rows where the predicate is present and true."""
        scope = self._scope()
        return self._after(self._sdf.filter(E.as_expression(predicate).condition(scope)), scope, keep_groups=False)

    def remove(self, predicate: Any) -> Frame:
        """The other rows: where it is false or missing."""
        scope = self._scope()
        held = E.as_expression(predicate).typed(scope).truth()
        return self._after(self._sdf.filter(~F.coalesce(held, F.lit(False))), scope, keep_groups=False)

    def derive(self, **columns: Any) -> Frame:
        """New columns, in order: later expressions see earlier ones. Groups stay. The first reduction of a whole column stays
        lazy; one of a frame that holds such already is computed now, so that plans do not copy plans that copy plans."""
        out = self
        for name, value in columns.items():
            scope = out._scope()
            out = out._after(out._put(name, E.as_expression(value).typed(scope).column), scope, keep_groups=True)
        return out

    def group_by(self, *names: str) -> Frame:
        """Keys as they are now: deriving a key anew does not change the groups."""
        names = tuple(dict.fromkeys(names))
        self.check(*names)
        base = self.sdf
        hidden = tuple(f"{GROUP}{i}" for i in range(len(names)))
        sdf = base.select("*", *[F.col(quoted(n)).alias(h) for n, h in zip(names, hidden)]) if names else base
        return Frame(sdf, names, hidden, self._reduced)

    def ungroup(self) -> Frame:
        return self._with(self._sdf, keep_groups=False)

    def aggregate(self, **outputs: tuple[str, Callable] | tuple[str, Callable, str]) -> Frame:
        """One row for each group: its keys, then each output = (column, function of the values present)."""
        if self.keys is None:
            raise ValueError("aggregate needs groups")
        scope, columns = self._scope(), []
        for name, (source, function, *kind) in outputs.items():
            self.check(source)
            column, _ = aggregate_column(function, scope.ref(source), *kind)
            columns.append(column.alias(name))
        # A constant key makes the one group of no keys, and none of no rows.
        key = [F.col(h).alias(k) for h, k in zip(self._snapshot, self.keys)] or [F.lit("all").alias(GROUP)]
        if not columns:
            out = self._sdf.select(*key).distinct()
        else:
            out = self._sdf.groupBy(*key).agg(*columns)
        shown = [k for k in self.keys if k not in outputs]
        order = [n for n in self.keys if n in outputs or n in shown]
        names = [*order, *[n for n in outputs if n not in order]]
        if not set(outputs) & set(self.keys):
            return Frame(out.select(*[F.col(quoted(n)) for n in names]), reduced=self._reduced)
        renamed = out.toDF(*[*[f"k{i}" for i in range(len(key))], *[f"o{i}" for i in range(len(outputs))]])
        place = {k: f"k{i}" for i, k in enumerate(self.keys)} | {n: f"o{i}" for i, n in enumerate(outputs)}
        return Frame(renamed.select(*[F.col(place[n]).alias(n) for n in names]), reduced=self._reduced)

    def gather_call(self, name: str, function: Callable, *columns: str, returns: str = "double", gather: bool = False) -> Frame:
        """A function of whole columns that nothing else can express. It holds them in one task, so it must be allowed
        with gather=True, and only suits frames that fit there. Missing values are left out."""
        if not gather:
            raise ValueError("gather=True is needed: whole columns go to one task")
        self.check(*columns)
        rows = self._numbered()
        schema = T.StructType([T.StructField(ORDINAL, T.LongType()), T.StructField("__value", T._parse_datatype_string(returns))])

        def run(pdf):
            pdf = pdf.sort_values(ORDINAL)
            ok = pdf[list(columns)].notna().all(axis=1)
            pdf["__value"] = None
            pdf.loc[ok, "__value"] = function(*[pdf.loc[ok, x].to_numpy() for x in columns])
            return pdf[[ORDINAL, "__value"]]

        found = rows.select(ORDINAL, *map(quoted, columns)).groupBy().applyInPandas(run, schema)
        joined = self._with(rows.join(found, ORDINAL))
        return self._with(joined._put(name, F.col("__value")).drop(ORDINAL, "__value"))


def as_text(x: SparkColumn, kind: DataType | None) -> SparkColumn:
    """Values as Python prints them, as far as the strict types can read them back."""
    if kind == DataType.BOOLEAN:
        return F.when(x, "True").when(~x, "False")
    return x.cast("string")


def evaluate(frame: Frame, expression: Expression):
    """(values, mask) of an expression as arrays; collects them."""
    import numpy as np

    typed = expression.typed(Scope(frame._sdf))
    rows = [r[0] for r in frame._sdf.select(typed.column).collect()]
    filler = "" if typed.kind == E.TEXT else False if typed.kind == E.BOOL else 0
    return np.array([filler if v is None else v for v in rows]), np.array([v is not None for v in rows], bool)

