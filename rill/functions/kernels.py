"""How called functions run on Spark.

In this order: a NumPy function that Spark has natively becomes that column function; a reduction becomes a scalar
subquery; any other function is traced, that is, called once on symbolic arguments, and what it does to them becomes an
expression (``lambda x: x - np.mean(x)`` needs no Python on the executors); a function marked ``rowwise`` or a NumPy
ufunc that cannot be traced runs as a vectorised Arrow function. What remains sees whole columns and cannot be
distributed; it is refused unless ``gather=True`` allows one task to hold them.
"""

from __future__ import annotations

import statistics
import types
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr as E
from .expr import BOOL, FLOAT, INT, NUMBERS, TEXT, Typed


def rowwise(function: Callable) -> Callable:
    """Marks a function whose result for a row depends on that row alone."""
    function.__rowwise__ = True
    return function


def gathers(function: Callable) -> Callable:
    """Marks an aggregate that may hold the values of a whole group in one place. It suits groups of bounded size only."""
    function.__gathers__ = True
    return function


def is_rowwise(function: Callable) -> bool:
    return isinstance(function, np.ufunc) or getattr(function, "__rowwise__", False)


def _double(make: Callable[..., Column]) -> Callable[..., Typed]:
    def run(*args: Typed) -> Typed:
        return Typed(make(*[a.number().cast("double") for a in args]), FLOAT)

    return run


def _floor(v: Column) -> Column:
    """Of doubles. Spark's floor and ceil are longs, which have no negative zero, no NaN, no infinities and an end; from 2^52 on all
    doubles are whole."""
    return F.when((v != 0) & (F.abs(v) < F.lit(2.0**52)), F.floor(v).cast("double")).otherwise(v)


def _logarithm(make: Callable[[Column], Column], offset: float = 0.0) -> Callable[..., Typed]:
    """Spark gives null outside the domain where NumPy gives -inf and NaN."""

    def run(x: Typed) -> Typed:
        v = x.number().cast("double")
        edge = v + F.lit(offset)
        value = F.when(edge > 0, make(F.when(edge > 0, v))).when(edge == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return Typed(F.when(v.isNotNull(), value), FLOAT)

    return run


def _same_kind(make: Callable[[Column], Column]) -> Callable[..., Typed]:
    def run(x: Typed) -> Typed:
        return Typed(make(x.number()), FLOAT if x.kind == FLOAT else INT)

    return run


def _extreme(make: Callable, symbol: str) -> Callable[..., Typed]:
    """NaN wins, null is strict."""

    def run(a: Typed, b: Typed) -> Typed:
        x, y = a.number(), b.number()
        value = make(x, y)
        if FLOAT in (a.kind, b.kind):
            x, y = x.cast("double"), y.cast("double")
            value = F.when(F.isnan(x) | F.isnan(y), F.lit(float("nan"))).otherwise(make(x, y))
        return Typed(E.both(a, b, value), FLOAT if FLOAT in (a.kind, b.kind) else INT)

    return run


def _modulo(a: Typed, b: Typed) -> Typed:
    """The sign of the divisor; by zero: NaN for floats, zero for whole numbers."""
    if FLOAT in (a.kind, b.kind):
        x, y = a.double(), b.double()
        r = x % F.when(y != 0, y)
        return Typed(E.both(a, b, F.when(y == 0, F.lit(float("nan"))).otherwise(F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r))), FLOAT)
    x, y = a.number(), b.number()
    r = x % F.when(y != 0, y)
    return Typed(E.both(a, b, F.when(y == 0, F.lit(0).cast("long")).otherwise(F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r))), INT)


def _floor_divide(a: Typed, b: Typed) -> Typed:
    if FLOAT in (a.kind, b.kind):
        q = E.divide(a, b).column
        finite = ~F.isnan(q) & (F.abs(q) != F.lit(float("inf")))
        return Typed(F.when(finite, F.floor(F.when(finite, q)).cast("double")).otherwise(q), FLOAT)
    m = _modulo(a, b).column
    y = F.when(b.number() != 0, b.number())
    return Typed(E.both(a, b, F.when(b.number() == 0, F.lit(0).cast("long")).otherwise(F.expr("0").cast("long") + ((a.number() - m) / y).cast("long"))), INT)


def _test(make: Callable[[Column], Column]) -> Callable[..., Typed]:
    def run(x: Typed) -> Typed:
        return Typed(F.when(x.column.isNotNull(), make(x.number().cast("double"))), BOOL)

    return run


_INF = float("inf")
NATIVE: dict[Callable, Callable[..., Typed]] = {
    np.add: E.add, np.subtract: E.subtract, np.multiply: E.multiply, np.divide: E.divide, np.power: E.power,
    np.equal: E.compare("=="), np.not_equal: E.compare("!="), np.less: E.compare("<"), np.less_equal: E.compare("<="),
    np.greater: E.compare(">"), np.greater_equal: E.compare(">="),
    np.logical_and: E.logical("&"), np.logical_or: E.logical("|"),
    np.logical_not: lambda x: Typed(~x.truth(), BOOL),
    np.logical_xor: lambda a, b: Typed(E.both(a, b, a.truth() != b.truth()), BOOL),
    np.absolute: _same_kind(F.abs), np.negative: _same_kind(lambda v: -v), np.positive: _same_kind(lambda v: v),
    np.sign: _double(lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v))),
    np.square: lambda x: E.multiply(x, x),
    np.sqrt: _double(F.sqrt), np.cbrt: _double(F.cbrt), np.exp: _double(F.exp), np.expm1: _double(F.expm1), np.exp2: _double(lambda v: F.pow(F.lit(2.0), v)),
    np.log: _logarithm(F.ln), np.log2: _logarithm(F.log2), np.log10: _logarithm(F.log10), np.log1p: _logarithm(F.log1p, 1.0),
    np.sin: _double(F.sin), np.cos: _double(F.cos), np.tan: _double(F.tan), np.arcsin: _double(F.asin), np.arccos: _double(F.acos), np.arctan: _double(F.atan), np.arctan2: _double(F.atan2),
    np.sinh: _double(F.sinh), np.cosh: _double(F.cosh), np.tanh: _double(F.tanh), np.arcsinh: _double(F.asinh), np.arccosh: _double(F.acosh), np.arctanh: _double(F.atanh),
    np.floor: _double(_floor), np.ceil: _double(lambda v: -_floor(-v)), np.rint: _double(F.rint),
    np.hypot: _double(F.hypot), np.degrees: _double(F.degrees), np.rad2deg: _double(F.degrees), np.radians: _double(F.radians), np.deg2rad: _double(F.radians),
    np.mod: _modulo, np.floor_divide: _floor_divide,
    np.maximum: _extreme(F.greatest, "max"), np.minimum: _extreme(F.least, "min"),
    np.isnan: _test(F.isnan), np.isfinite: _test(lambda v: ~F.isnan(v) & (F.abs(v) != _INF)), np.isinf: _test(lambda v: F.abs(v) == _INF),
    abs: _same_kind(F.abs), np.fabs: _double(F.abs),
}


def n_distinct(values) -> int:
    """The number of different values."""
    return len(set(values))


def _counted(x: Typed) -> Column:
    return F.when(F.count(x.column) > 0, F.count(x.column))


def _total(x: Typed) -> Column:
    return F.sum(x.number())


def _kept(make: Callable[[Column], Column]) -> Callable[[Typed], Column]:
    return lambda x: make(x.column if x.kind not in (BOOL,) else x.column)


def _of_double(make: Callable[[Column], Column]) -> Callable[[Typed], Column]:
    return lambda x: make(x.number().cast("double"))


#: Reductions over the values that are present: function -> (aggregate, kind; None: the argument's).
REDUCERS: dict[Callable, tuple[Callable[[Typed], Column], str | None]] = {}
for _functions, _make, _kind in (
    ((len, np.size), _counted, INT),
    ((sum, np.sum), _total, "sum"),
    ((min, np.min), _kept(F.min), None),
    ((max, np.max), _kept(F.max), None),
    ((statistics.mean, statistics.fmean, np.mean, np.average), _of_double(F.avg), FLOAT),
    ((statistics.median, np.median), _of_double(F.median), FLOAT),
    ((np.std, statistics.pstdev), _of_double(F.stddev_pop), FLOAT),
    ((np.var, statistics.pvariance), _of_double(F.var_pop), FLOAT),
    ((statistics.stdev,), _of_double(F.stddev_samp), FLOAT),
    ((statistics.variance,), _of_double(F.var_samp), FLOAT),
    ((n_distinct,), lambda x: F.when(F.count(x.column) > 0, F.count_distinct(x.column)), INT),
    ((any, np.any), lambda x: F.bool_or(x.truth()), BOOL),
    ((all, np.all), lambda x: F.bool_and(x.truth()), BOOL),
):
    for _f in _functions:
        REDUCERS[_f] = (_make, _kind)


def reduced(function: Callable, x: Typed) -> Typed:
    make, kind = REDUCERS[function]
    if kind == "sum":
        kind = FLOAT if x.kind == FLOAT else INT
    return Typed(make(x), kind or x.kind)


class Traced:
    """Stands for a column, or for what a reduction makes of it, while a user's function runs."""

    __array_priority__ = 1000

    def __init__(self, value: Typed, reduce: Callable[[Callable, Typed], Typed]):
        self.value, self.reduce = value, reduce

    def apply(self, function: Callable[..., Typed], *others: Any, swapped: bool = False) -> Traced:
        own = [o.value if isinstance(o, Traced) else constant(o) for o in others]
        args = [*own, self.value] if swapped else [self.value, *own]
        return Traced(function(*args), self.reduce)

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        if method != "__call__" or options or ufunc not in NATIVE:
            return NotImplemented
        return Traced(NATIVE[ufunc](*[i.value if isinstance(i, Traced) else constant(i) for i in inputs]), self.reduce)

    def __array_function__(self, function, kinds, args, options):
        if options or len(args) != 1 or function not in REDUCERS:
            return NotImplemented
        return self.reduced(function)

    def reduced(self, function: Callable) -> Traced:
        return Traced(self.reduce(function, self.value), self.reduce)

    mean = lambda self: self.reduced(np.mean)
    sum = lambda self: self.reduced(np.sum)
    min = lambda self: self.reduced(np.min)
    max = lambda self: self.reduced(np.max)
    std = lambda self: self.reduced(np.std)
    var = lambda self: self.reduced(np.var)
    __hash__ = None

    def __neg__(self) -> Traced:
        return self.apply(NATIVE[np.negative])

    def __abs__(self) -> Traced:
        return self.apply(NATIVE[np.absolute])

    def __invert__(self) -> Traced:
        return self.apply(NATIVE[np.logical_not])

    def __bool__(self):
        raise TypeError("a traced column has no single truth value")


def _traced_operator(function: Callable[..., Typed], swapped: bool = False) -> Callable:
    return lambda self, other: self.apply(function, other, swapped=swapped)


for _name, _function in {
    "add": E.add, "sub": E.subtract, "mul": E.multiply, "truediv": E.divide, "pow": E.power, "mod": _modulo,
    "floordiv": _floor_divide, "and": E.logical("&"), "or": E.logical("|"),
}.items():
    setattr(Traced, f"__{_name}__", _traced_operator(_function))
    setattr(Traced, f"__r{_name}__", _traced_operator(_function, swapped=True))
for _name, _symbol in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Traced, f"__{_name}__", _traced_operator(E.compare(_symbol)))


def constant(value: Any) -> Typed:
    return E.Const(value).typed(None)


def _symbolic(function: Callable, name: str) -> Callable:
    def run(x, *rest, **options):
        if isinstance(x, Traced) and not rest and not options:
            return x.reduced(function)
        return function(x, *rest, **options)

    run.__name__ = name
    return run


class _Statistics:
    """The statistics module with its reductions symbolic."""

    def __getattr__(self, name: str):
        own = getattr(statistics, name)
        return _symbolic(own, name) if own in REDUCERS else own


def traced(function: Callable, args: list[Typed], reduce: Callable[[Callable, Typed], Typed]) -> Typed | None:
    """What a Python function makes of columns, or None if it cannot be told without values."""
    if not isinstance(function, types.FunctionType):
        return None
    scope = dict(function.__globals__)
    for name, own in {"len": len, "sum": sum, "min": min, "max": max, "any": any, "all": all, "abs": abs}.items():
        if scope.get(name, own) is own:
            scope[name] = _symbolic(own, name) if own in REDUCERS else own
    for name, own in list(scope.items()):
        if own is statistics:
            scope[name] = _Statistics()
        elif isinstance(own, types.FunctionType) and own in REDUCERS:
            scope[name] = _symbolic(own, name)
    own = types.FunctionType(function.__code__, scope, function.__name__, function.__defaults__, function.__closure__)
    own.__kwdefaults__ = function.__kwdefaults__
    try:
        out = own(*[Traced(a, reduce) for a in args])
    except Exception:  # whatever the function needs, symbols do not have it
        return None
    return out.value if isinstance(out, Traced) else None


def arrow_function(function: Callable, args: list[Typed], returns: str, fill: Any) -> Typed:
    """A row-wise function in Arrow batches. It sees the rows where no argument is missing, or ``fill`` there."""
    import pandas as pd

    def run(*series: pd.Series) -> pd.Series:
        missing = pd.concat([s.isna() for s in series], axis=1).any(axis=1) if series else pd.Series(dtype=bool)
        own = [s.fillna(fill) for s in series] if fill is not None else [s[~missing] for s in series]
        out = pd.Series(np.asarray(function(*[s.to_numpy() for s in own])), index=own[0].index)
        return out.astype(object).reindex(series[0].index).where(~missing, None)

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, returns)
    kind = {"double": FLOAT, "float": FLOAT, "long": INT, "bigint": INT, "int": INT, "string": TEXT, "boolean": BOOL}.get(returns, E.OTHER)
    columns = [a.double() if a.kind == FLOAT else a.column for a in args]
    # NaN is a value here, not a missing one, so validity is decided outside.
    valid = F.lit(True)
    for a in args:
        valid = valid & a.column.isNotNull()
    return Typed(F.when(valid, udf(*columns)), kind)


def compiled(node: E.Call, scope: E.Scope) -> Typed:
    f, args = node.function, [a.typed(scope) for a in node.arguments]
    if node.fill_missing is not None:
        kinds = {FLOAT: "double", INT: "long", TEXT: "string", BOOL: "boolean"}
        filled = [Typed(F.coalesce(a.column, F.lit(node.fill_missing).cast(kinds.get(a.kind, "string"))), a.kind) for a in args]
    else:
        filled = args

    def strict(t: Typed) -> Typed:
        """Null wherever an argument is null."""
        ok = F.lit(True)
        for a in args:
            ok = ok & a.column.isNotNull()
        return Typed(F.when(ok, t.column), t.kind)

    def reduce(function: Callable, x: Typed) -> Typed:
        r = reduced(function, x)
        return Typed(scope.scalar(r.column), r.kind)

    if f in NATIVE:
        return strict(NATIVE[f](*filled))
    if f in REDUCERS and len(args) == 1:
        return strict(reduce(f, filled[0]))
    found = traced(f, filled, reduce)
    if found is not None:
        return strict(found)
    if is_rowwise(f):
        return arrow_function(f, filled, node.returns, node.fill_missing)
    raise TypeError(
        f"{getattr(f, '__name__', f)} needs whole columns in one place; mark it with rowwise if a row's value depends on "
        "that row alone, or apply it with Frame.gather_call"
    )


def aggregate_column(function: Callable, x: Typed, returns: str | None = None) -> tuple[Column, str | None]:
    """The aggregate for a callable over the values that are present; null for a group without any."""
    if function in REDUCERS:
        r = reduced(function, x)
        return r.column, None
    found = traced(function, [x], reduced)
    if found is not None:
        return F.when(F.count(x.column) > 0, found.column), None
    if not getattr(function, "__gathers__", False):
        raise TypeError(
            f"{getattr(function, '__name__', function)} needs the values of each group in one place; mark it with gathers if every "
            "group is small enough for that"
        )
    kind = returns or {BOOL: "boolean", INT: "long", FLOAT: "double"}.get(x.kind, "string")
    run = F.udf(lambda v: plain_value(function(v)) if v else None, kind)
    return run(F.collect_list(x.column)), kind


def plain_value(v: Any) -> Any:
    return v.item() if hasattr(v, "item") else v
