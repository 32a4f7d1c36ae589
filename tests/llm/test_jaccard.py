import random

import numpy as np
import pytest

from rill.llm import common, graph
from rill.llm import jaccard as J


def made(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, i = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 80]))]
        for _ in range(rnd.choice([1, 3, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append((i, " ".join(w)))
            i += 1
    docs += [(i, docs[0][1]), (i + 1, docs[0][1].upper() + "!"), (i + 2, ""), (i + 3, None), (i + 4, "!!"), (i + 5, "one"), (i + 6, "One.")]
    return docs


@pytest.mark.parametrize("block_rows", [256, 3])
def test_rows_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(J, "BLOCK_ROWS", block_rows)
    docs = made()
    df = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, rep int, label string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(df).collect()}
    assert got == J.brute_force(docs)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (None, "x")], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 2, 0), (None, 2, 2, 0)]
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    a, b, d = "a b c d e f g h", "n o p q r s t u", "n o p q r s t u v"
    rows = [(7, a), (7, b), (3, d), (9, a), (9, a), (12, "x y z"), (12, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in J.near_duplicates(df).collect())
    assert got == [(3, 3, 3, 1), (7, 3, 7, 1), (7, 7, 7, 2), (9, 7, 7, 2), (9, 7, 7, 2), (12, 12, 12, 1), (12, 12, 12, 1)]
    assert sorted(tuple(r) for r in J.keep_one(df).collect()) == [(3, d), (7, a), (12, "x y z")]


def test_keep_one_of_each_component(spark):
    """Two classes with one smallest id, and rows without an id: alone, with each other and with others."""
    a, b, c, d = ("a b c d e f g h", "n o p q r s t u v w x y z 1 2", "k1 k2 k3 k4 k5 k6", " ".join(f"q{i}" for i in range(30)))
    rows = [(7, a), (9, a), (7, b), (12, b + " 3"), (None, c), (None, c), (None, c.upper()), (None, d), (None, d + " e"), (20, d + " f"), (None, "alone"), (None, None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in J.keep_one(df).collect()]
    low = [(i, None if t is None else t.lower()) for i, t in kept]
    assert sorted(low, key=str) == sorted([(7, a), (7, b), (None, c), (20, d + " f"), (None, "alone"), (None, None), (None, None), (None, "")], key=str)
    assert set(kept) <= set(rows)


def test_keep_one_keeps_columns(spark):
    docs = made(2)
    df = spark.createDataFrame([(*x, "en") for x in docs], "doc_id long, text string, lang string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    want = J.brute_force(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)


def test_given_tables(spark, small):
    from rill.llm.registry import op2_ngram_jaccard

    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op2_ngram_jaccard(spark, small).collect()}
    assert got == J.brute_force(docs)


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.95)):
        b, r = J.choose_bands(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and b * r <= J.MOST_HASHES


def test_minhash_estimates_similarity():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = J.multipliers(2000)
    x, y = J.minhash(base[:900], a, b), J.minhash(base[100:], a, b)
    assert abs((x == y).mean() - 0.8) < 0.04


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201), (201, 202), (203, 202)]
    rnd = random.Random(3)
    edges = [e if rnd.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(4)}
    assert got == want


def test_differences_tell_the_same_links():
    """Sets and what they differ in from a base, whole and split, against Python sets."""
    rnd = random.Random(4)
    base = {rnd.randrange(1 << 60) for _ in range(60)}
    sets = []
    for _ in range(40):
        kept = {g for g in base if rnd.random() > rnd.choice([0.02, 0.1, 0.3])}
        sets.append(kept | {rnd.randrange(1 << 60) for _ in range(rnd.choice([0, 1, 9]))})
    sets += [set(sets[0]), set(base)]
    want = np.array([[i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    whole = [np.array(sorted(s), np.uint64) for s in sets]
    short = [np.array(sorted(s ^ base), np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    assert want.any() and not want.all()
    assert (J.similar(whole, 0.8) == want).all() and (J.similar(short, 0.8, None, sizes, len(base)) == want).all()
    crossing = want.copy()
    crossing[:15, :15] = crossing[15:, 15:] = False
    assert (J.similar(whole, 0.8, 15) == crossing).all() and (J.similar(short, 0.8, 15, sizes, len(base)) == crossing).all()


def test_edges_grow_with_the_members_of_a_group(spark, monkeypatch):
    """Near copies, each with another word changed: what components gets is at most two edges a member, at every size."""
    seen = []
    monkeypatch.setattr(J, "BLOCK_ROWS", 256)
    monkeypatch.setattr(J, "components", lambda edges: seen.append(edges.count()) or graph.components(edges))
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    for n in (1500, 3000, 6000):
        docs = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(n)]
        got = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).agg({"class_id": "max", "n_links": "min"}).first()
        assert got["max(class_id)"] == 0 and got["min(n_links)"] > n // 2
        assert all(k <= 2 * n for k in seen[-2:]), (n, seen)


def test_long_texts_and_other_columns(spark, monkeypatch):
    """A text of many more n-grams than a block, its near copies, and columns named as the operator's own."""
    monkeypatch.setattr(J, "BLOCK_GRAMS", 3000)
    rnd = random.Random(6)
    long = [f"w{rnd.randrange(5000)}" for _ in range(20_000)]
    docs = [(i, " ".join([*long[:i], *long])) for i in range(4)] + [(9, " ".join(long[:5000]))]
    df = spark.createDataFrame([(*x, "n", 1, "l") for x in docs], "doc_id long, text string, node string, links int, label string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(df).collect()} == J.brute_force(docs)


def test_components_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(130, 200 + i) for i in range(30)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in [*range(100, 131), *range(200, 230)]}
    same = graph.contracted(spark.createDataFrame([(5, 1), (5, 2), (6, 2), (6, 3), (7, 9)], "a long, b long"))
    assert sorted(tuple(r) for r in same.collect()) == [(2, 1), (3, 2), (5, 1), (6, 2), (7, 9)]
