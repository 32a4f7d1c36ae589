import math

import numpy as np
import pytest

from rill.llm import neighbours as N


def brute(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and len(v) == len(rows[0][1]) and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for i, q in ok:
        if asked(i) and i not in out:
            scored = sorted((-N.inner(x[None], q)[0], j) for j, x in ok if j != i)
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


@pytest.mark.parametrize("block", [4096, 7])
def test_recall_order_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((900, 32)).astype(np.float32)
    x[100:160] = x[5]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 32), (1040, [None] + [1.0] * 31), (1060, [float("nan")] * 32), (1080, [1.0]), (1100, []), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id long, embedding array<float>, score double, code int")
    got, want = found(N.nearest(df, "vec_id % 20 = 0")), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert sum(got[q] == want[q] for q in want) >= 0.95 * len(want)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert found(N.nearest(df, "vec_id % 20 = 0")) == {0: [(1, 1, 1.0), (2, 2, 0.5)]}
    assert N.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_given_table_has_full_recall(spark, small):
    from rill.llm.registry import op10_one_bit_codes

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(op10_one_bit_codes(spark, small)) == brute(rows, lambda i: i % 20 == 0, 20)


@pytest.mark.parametrize("dim", [1, 8, 63, 64, 100])
def test_counts_of_bits_are_inner_products(dim):
    """Population counts of packed words against the products of signs and rounded queries; estimates within their bounds."""
    rnd = np.random.default_rng(dim)
    x, q = rnd.standard_normal((300, dim)), rnd.standard_normal((9, dim))
    turn, centre = N.rotation(dim), x.mean(axis=0)
    code, length, f, at = N.encode(x, centre, turn)
    s = N.Search(np.arange(9), q, centre, turn, 5, N.EPSILON)
    words = N.packed_words(code)
    signs = np.unpackbits(code, axis=1, count=dim) * 2.0 - 1
    got = s.step[:, None] * s.counted(words, slice(None)) + s.low[:, None] * np.bitwise_count(words).sum(axis=1) - s.all[:, None]
    turned = q @ turn / np.sqrt(dim)
    assert np.abs(got - turned @ signs.T).max() <= s.rounding.max() + 1e-4
    est = got * (length / f) + s.at_centre[:, None]
    slack = s.norm[:, None] * length * np.sqrt(np.maximum(1 - f * f, 0)) / f * s.scale + s.rounding[:, None] * (length / f) + 1e-4
    assert (np.abs(est - q @ x.T) <= slack).mean() > 0.995


def test_other_dimensions_repeated_ids_and_ties(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(a) for a in rnd.standard_normal(12)]) for i in range(100)]
    odd = [(200 + i, [1.0] * n) for i, n in enumerate([1, 2, 11, 13, 40])]
    more = [*rows, (20, rows[3][1]), (105, rows[7][1]), (106, rows[7][1])]
    df = spark.createDataFrame([*more, *odd], "vec_id long, embedding array<double>")
    got = found(N.nearest(df, "vec_id % 20 = 0", k=7))
    assert got.keys() == {0, 20, 40, 60, 80}
    for q in (0, 40, 60, 80):
        assert got[q] == brute(more, lambda i: i == q, 7)[q]
