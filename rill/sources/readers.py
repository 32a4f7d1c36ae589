"""Reading delimited text with types inferred from whole columns, and Parquet.

Text is read in parallel and stays on the executors. One aggregate over all rows counts, for each column, the values
that read as each type; the driver sees that one row. Typed columns are lazy casts.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import PARSED, SPARK, DataType, missing_column, parsed, reads_as, trimmed
from ..operators.frame import Frame, session

EXTRA = "__extra"


def unique_names(names: list[str | None]) -> list[str]:
    """Repeated names get _1, _2, …; a null name is "None". A name made so that is there already is an error."""
    seen: dict[str, int] = {}
    out = []
    for n in map(str, names):
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    if len(set(out)) < len(out):
        raise ValueError("column names repeat")
    return out


def read_csv(path: str, header: bool = True, skip: int = 0, multiline: bool | None = None) -> Frame:
    """A delimited file, or a folder of such files with the same columns.

    ``skip`` lines are left out at the beginning (of a single file); with ``header`` the next record has the names, without
    one they are x_0, x_1, …. ``multiline``: whether quoted values hold line breaks, so that a file is read as a whole, in one task;
    None: looks whether a line has an odd number of quotes. Rows that are too short end in nulls; too long ones raise.
    """
    spark = session()
    lines = spark.read.text(path)
    top = [r[0] for r in lines.limit(skip + 1).collect()]
    if len(top) <= skip:
        raise ValueError("no columns")
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = bool(lines.where(quotes % 2 == 1).limit(1).count())
    quoting = {"quote": '"', "escape": '"', "nullValue": "\x00"}
    whole = records(path, skip) if multiline and skip else None
    if whole is not None:
        cells = whole.where("number = 0").first()["cells"]
    elif multiline and header:
        cells = list(spark.read.options(**quoting, multiLine=True).csv(path).limit(1).collect()[0])
    else:
        cells = next(csv.reader([top[skip]]), [""])
    names = unique_names(["None" if v is None else v for v in cells]) if header else [f"x_{i}" for i in range(len(cells))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, EXTRA)])
    if whole is not None:
        kept = whole.where(F.col("number") >= int(header))
        raw = kept.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate((*names, EXTRA))])
    elif skip:
        # The first lines of a single file are the first of its first partition.
        kept = lines.withColumn("at", F.monotonically_increasing_id()).where(F.col("at") >= skip + header)
        plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
        raw = kept.select(F.from_csv("value", plain.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options=quoting).alias("row"))
        raw = raw.select("row.*").toDF(*names, EXTRA)
    else:
        raw = spark.read.options(**quoting, mode="PERMISSIVE", multiLine=multiline, enforceSchema=True, header=header).schema(schema).csv(path)
    return infer_types(raw, names)


def records(path: str, skip: int) -> SparkFrame:
    """(number, cells) of the records of a file behind its first lines. Quoted values may hold line breaks, so a file is one task's;
    records come one by one."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                stream = io.StringIO(text, newline="")
                for _ in range(skip):
                    stream.readline()
                rows = (r for r in csv.reader(stream, quoting=csv.QUOTE_NOTNULL) if r)  # what is empty and not quoted is missing
                number = 0
                while held := list(itertools.islice(rows, 10_000)):
                    numbers = pa.array(range(number, number + len(held)), pa.int64())
                    yield pa.RecordBatch.from_arrays([numbers, pa.array(held, pa.list_(pa.string()))], names=["number", "cells"])
                    number += len(held)

    return session().read.text(path, wholetext=True).mapInArrow(parse, "number bigint, cells array<string>")


def infer_types(raw: SparkFrame, names: list[str]) -> Frame:
    """Types for text columns, decided over all rows in one pass."""
    checks = [F.count_if(F.col(EXTRA).isNotNull()).alias("extra")] if EXTRA in raw.columns else []
    narrow = PARSED[:3]
    for i, n in enumerate(names):
        x = F.col(f"`{n}`")
        there = x.isNotNull() & ~missing_column(x)
        bare = trimmed(x)
        is_bool, is_int = reads_as(bare, DataType.BOOLEAN), reads_as(bare, DataType.INT64)
        checks.append(F.count_if(there).alias(f"seen{i}"))
        for kind, holds in zip(narrow, (is_bool, is_int, reads_as(bare, DataType.FLOAT64))):
            checks.append(F.count_if(there & holds).alias(f"{kind}{i}"))
            checks.append(F.count_if(there & reads_as(x, kind)).alias(f"raw_{kind}{i}"))
    found = raw.agg(*checks).first().asDict()
    if found.get("extra"):
        raise ValueError("a row has more values than there are columns")
    return Frame(raw.select(*[typed(n, *decide(found, i)).alias(n) for i, n in enumerate(names)]))


def decide(found: dict[str, int], i: int) -> tuple[DataType, bool]:
    """A column's type, and whether nothing is there."""
    seen = found[f"seen{i}"]
    if not seen:
        return DataType.STRING, True
    kind = next((k for k in PARSED[:3] if found[f"{k}{i}"] == seen), DataType.STRING)
    # Text that only reads once trimmed leaves the column as it is.
    if kind != DataType.STRING and found[f"raw_{kind}{i}"] < seen:
        return DataType.STRING, False
    return kind, False


def typed(name: str, kind: DataType, empty: bool) -> SparkColumn:
    x = F.col(f"`{name}`")
    if empty:
        return F.lit(None).cast("string")
    if kind == DataType.STRING:
        return x
    return F.when(~missing_column(x), parsed(x, kind)).cast(SPARK[kind])


def read_parquet(path: str) -> Frame:
    return Frame(session().read.parquet(path))


def write_parquet(frame: Frame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    frame.sdf.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    frame.sdf.write.mode(mode).options(header=True, escape='"').csv(path)
