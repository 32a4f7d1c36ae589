import random

import pytest
from pyspark.sql import functions as F

from rill import workload as K


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 0.95, 1.0])
@pytest.mark.parametrize("cells", [2, 4096])
def test_nearest_quantile(spark, q, cells):
    rnd = random.Random(1)
    xs = [rnd.choice([rnd.gauss(0, 1e6), float(rnd.randint(-3, 3)), 1e-300, None]) for _ in range(301)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    own = sorted(x for x in xs if x is not None)
    assert df.select(K.nearest_quantile(df, "x", q, cells=cells)).first()[0] == own[int((len(own) - 1) * q + 0.5)]
    assert df.select(K.nearest_quantile(df, "x", q, F.col("x") > 1e12)).first()[0] is None


@pytest.mark.parametrize("cells", [2, 64])
def test_infinite_and_whole_values(spark, cells):
    inf, big = float("inf"), 2**53
    real = [1.0, inf, 2.0, 3.0, -inf, float("nan"), None, -1e308, 1e308, 5e-324, 0.0]
    whole = [big + 1, big + 3, -(2**63), 2**63 - 1, None, big + 2, 0]
    df = spark.createDataFrame([(x, w) for x, w in zip(real, whole + [7] * 4)], "x double, w long")
    xs, ws = sorted(x for x in real if x is not None and x == x), sorted(w for w in whole + [7] * 4 if w is not None)
    wanted = [(n, q, None) for q in (0.0, 0.1, 0.5, 0.8, 1.0) for n in ("x", "w")]
    got = df.select(*[c.alias(f"q{i}") for i, c in enumerate(K.nearest_quantiles(df, wanted, cells))]).first()
    assert list(got) == [own[int((len(own) - 1) * q + 0.5)] for _, q, _ in wanted[::2] for own in (xs, ws)]
    assert K.nearest_quantiles(df, []) == []


def test_strict_category(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    strict, rank = K.ordered_category(F.col("x"), ["a", "b"])
    assert [tuple(r) for r in df.select(strict, rank).collect()] == [("b", 2), (None, None), ("a", 1)]
    with pytest.raises(Exception, match="no such level"):
        df.select(K.ordered_category(F.col("x"), ["a"])[0]).collect()
