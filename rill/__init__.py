"""A Spark-native pipeline engine: typed, null-aware frames, lazy expressions and ``>>`` pipelines."""

from .functions.expr import c, call
from .functions.kernels import gathers, n_distinct, rowwise
from .functions.types import DataType
from .operators.column import Column
from .operators.frame import Frame, evaluate
from .plans.pipeline import Pipeline, aggregate, derive, exclude, groupBy, keep, remove, select, ungroup
from .plans.verbs import Verb
from .sources.readers import read_csv, read_parquet, write_csv, write_parquet

DataFrame = Frame

__all__ = [
    "Column", "DataFrame", "DataType", "Frame", "Pipeline", "Verb", "aggregate", "c", "call", "derive", "evaluate", "exclude",
    "gathers", "groupBy", "keep", "n_distinct", "read_csv", "read_parquet", "remove", "rowwise", "select", "ungroup", "write_csv",
    "write_parquet",
]
