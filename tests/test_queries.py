"""Every query of the engine against DuckDB on the same tables."""

import math
import os
import struct
from decimal import Decimal

import duckdb
import pytest

from rill import queries as Q


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{small}/{t}'")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f + 0.0:.9g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(name, spark, small, duck):
    got = Q.QUERIES[name](spark, small)
    want = duck.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_division_by_zero_to_the_bit(spark, small, duck):
    """The NaN of 0 / 0 has the sign that the machine gives it, as DuckDB's has: as texts they would differ."""
    bits = lambda rows: sorted((*r[:2], *(struct.pack(">d", v) for v in r[2:])) for r in rows)
    got = bits(map(tuple, Q.QUERIES["derive_div_ieee"](spark, small).collect()))
    assert got == bits(duck.execute(Q.SQL["derive_div_ieee"]).fetchall())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(Q.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """The entry module and all else import where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rill", tmp_path / "rill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
