import pytest

from rill import Frame, n_distinct
from rill.operators import relational as R


@pytest.fixture(scope="module")
def crates(spark):
    return Frame.from_list([["a", "b", "b", None], [1, 2, 3, 4]], ["shelf", "n"])


@pytest.fixture(scope="module")
def shelves(spark):
    return Frame.from_list([["b", "c", None], [20, 30, 40]], ["name", "room"])


def rows(frame):
    return sorted((tuple(r) for r in frame.sdf.collect()), key=str)


@pytest.mark.parametrize(
    "how, want",
    [
        ("inner", [("b", 2, 20), ("b", 3, 20)]),
        ("left", [("a", 1, None), ("b", 2, 20), ("b", 3, 20), (None, 4, None)]),
        ("right", [("b", 2, 20), ("b", 3, 20), ("c", None, 30), (None, None, 40)]),
        ("full", [("a", 1, None), ("b", 2, 20), ("b", 3, 20), ("c", None, 30), (None, 4, None), (None, None, 40)]),
        ("semi", [("b", 2), ("b", 3)]),
        ("anti", [("a", 1), (None, 4)]),
    ],
)
def test_joins(crates, shelves, how, want):
    assert rows(R.join(crates, shelves, {"shelf": "name"}, how)) == sorted(want, key=str)
    assert rows(R.join(crates, shelves.rename_col("name", "shelf"), "shelf", how)) == sorted(want, key=str)


def test_joins_that_cannot_be(crates, shelves):
    for other, on, how, error in ((shelves, "shelf", "inner", KeyError), (shelves, {"shelf": "name"}, "outer", ValueError), (crates, ["shelf"], "inner", ValueError)):
        with pytest.raises(error):
            R.join(crates, other, on, how)


def test_sets_of_rows(crates):
    twice = R.union(crates, crates.select("n", "shelf"))
    assert twice.dims() == (2, 8) and rows(R.distinct(twice)) == rows(crates)
    some = crates.slice(1, 4)
    assert rows(R.intersect(twice, some)) == rows(some) and rows(R.subtract(twice, some)) == [("a", 1)]
    with pytest.raises(ValueError):
        R.union(crates, crates.select("n"))


def test_first_rows(crates):
    assert [tuple(r) for r in R.top(crates, 2, "shelf", "n").sdf.collect()] == [("b", 3), ("b", 2)]
    assert [tuple(r) for r in R.top(crates, 9, "shelf", "n", ascending=True).sdf.collect()] == [("a", 1), ("b", 2), ("b", 3), (None, 4)]


def test_subtotals(crates):
    got = rows(R.rollup(crates, ["shelf"], n=("n", len), d=("n", n_distinct)))
    assert got == sorted([("a", 1, 1, 0), ("b", 2, 2, 0), (None, 1, 1, 0), (None, 4, 4, 1)], key=str)


def test_text_over_frames(crates):
    assert rows(R.sql("SELECT max(n) AS top FROM {f} WHERE shelf = 'b'", f=crates)) == [(3,)]
