import random
import zlib

import numpy as np
import pytest

from rill.llm import quality as Q


def made(n=800, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(10, 120))]
        good = rnd.random() < 0.7
        t = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w) if i % 2 else " ".join([w[0]] * len(w))
        docs.append((i, t))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_column_equals_arrays(spark):
    docs, labels = made()
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    d = spark.createDataFrame([(*x, 1.0, 2) for x in docs] + [(9000, None, 0.0, 1), (9001, "", 0.0, 1), (5, "w1 w2", 0.0, 1)], "doc_id long, text string, score double, words int")
    learned = [x for x in labels if x[0] not in held] + [(None, 1), (3, None)]
    got = Q.score_quality(d, spark.createDataFrame(learned, "doc_id long, quality int")).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    judged = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if r.doc_id in held]
    assert np.mean(judged) > 0.97
    empty = {r.doc_id: r.score for r in got if r.doc_id >= 9000}
    assert empty[9000] == empty[9001]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_without_both_labels(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = Q.score_quality(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [r.score for r in got] == [1.0 if labels else 0.5] * 2
    assert Q.score_quality(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_rules_weigh_the_same_in_spark(spark):
    rnd = np.random.default_rng(3)
    x = rnd.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    m = Q.RuleEnsemble(x, y)
    assert 0 < len(m.rules) < 120
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r[0] for r in df.select(m.column(["a", "b", "c"])).collect()]
    assert np.allclose(got, m.score(x[:50]))


def test_keep_good_keeps_columns_and_good_rows(spark):
    docs, labels = made(seed=4)
    d = spark.createDataFrame([(*x, "en") for x in docs], "doc_id long, text string, lang string")
    kept = Q.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i, y in labels if y}
    assert len(good - ids) <= 0.01 * len(good) and len(ids - good) <= 0.03 * len(good)


def test_given_table_held_out(spark):
    from rill.llm.registry import op7_quality_rules

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(r.predicted, truth[r.doc_id]) for r in op7_quality_rules(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in own]) > 0.95
