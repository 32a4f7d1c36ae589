import random
import zlib

import numpy as np
import pytest

from rill.llm import toxicity as T


def made(n=900, seed=1):
    rnd = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "to", "shi", "ba", "nu", "fel", "dor"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(20, 150))]
        bad = rnd.random() < 0.25
        if bad:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["gruxwit", "vilepop", "zquat" + word()]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made()
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    odd = [(9000, None, 0.1, 1), (9001, "", 0.1, 1), (5, "kalo", 0.1, 1)]
    d = spark.createDataFrame([(*x, 0.5, 1) for x in docs] + odd, "doc_id long, text string, score double, toxic int")
    learned = [x for x in labels if x[0] not in held] + [(None, 1), (3, None)]
    got = T.score_toxicity(d, spark.createDataFrame(learned, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in held]) > 0.95
    empty = {r.doc_id: r.score for r in got if r.doc_id >= 9000}
    assert empty[9000] == empty[9001] < 0.5


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)]])
def test_without_both_labels(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert [r.score for r in T.score_toxicity(d, lab).collect()] == [0.0 if labels else 0.5] * 2
    assert T.score_toxicity(d.limit(0), lab).count() == 0


def test_features_cover_whole_texts():
    docs, labels = made()
    m = T.Model([t for _, t in docs], [y for _, y in labels])
    c = m.dictionaries.compressors()
    plain = next(t for (_, t), (_, y) in zip(docs, labels) if not y and len(t) > 300)
    late = plain * 10 + " gruxwit vilepop gruxwit"
    assert m.scores([late], c)[0] > m.scores([plain * 10], c)[0]
    together = T.features([plain, None, late], c)
    assert np.allclose(together, np.vstack([T.features([t], c) for t in (plain, None, late)]))


def test_copies_count_once():
    docs, labels = made(300)
    texts, y = [t for _, t in docs], [y for _, y in labels]
    one, more = T.Model(texts, y), T.Model(texts + texts[:20] * 5, y + y[:20] * 5, share=float(np.mean(y)))
    assert one.dictionaries.toxic == more.dictionaries.toxic and one.dictionaries.ordinary == more.dictionaries.ordinary


def test_gains_equal_one_by_one_compression():
    """Windows, their lengths under both dictionaries and what is counted of them, against plain loops and the library."""
    docs, labels = made(300)
    c = T.Model([t for _, t in docs], [y for _, y in labels]).dictionaries.compressors()
    for text in (docs[0][1], "Gruxwit, vilepop; KA lo", "", None, "one two three four five six seven"):
        words = (text or "").lower().replace(",", " ").replace(";", " ").split()
        windows, i = [], 0
        while True:
            windows.append(b"  " + b"  ".join(w.encode() for w in words[i : i + 6]) + b"  " + b"\n" * 9)
            if i + 6 >= len(words):
                break
            i += 3
        assert T.windows_of(T.words_of(text)) == windows
        want = [np.log(len(windows))]
        for ordinary, toxic in c:
            gain = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows]
            want += [max(gain), sum(gain) / len(gain)]
            for n in [sum(g >= k for g in gain) for k in range(1, 9)] + [sum(g <= -1 for g in gain)]:
                want += [np.log1p(n), n / len(gain)]
        assert np.allclose(T.features([text], c)[0], want)


def test_dictionaries_are_of_their_class():
    """Words of one class alone are in its dictionary only; what both have sets nothing apart."""
    docs, labels = made()
    d = T.Model([t for _, t in docs], [y for _, y in labels]).dictionaries
    assert b"gruxwit" in d.toxic and b"vilepop" in d.toxic and b"gruxwit" not in d.ordinary and len(d.toxic) == len(d.ordinary)
    words = [T.words_of(t) for _, t in docs]
    assert T.distinctive(words[:300], words[:300]) == set()


def test_long_texts_repeated_rows_and_nulls(spark):
    docs, labels = made(300)
    long = " ".join(t for _, t in docs) * 3 + " gruxwit vilepop" * 40
    d = spark.createDataFrame([*docs, (7, docs[7][1]), (900, long), (None, "ka lo")], "doc_id long, text string")
    got = T.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) + 3 and len({r.score for r in got if r.doc_id == 7}) == 1 and all(0 <= r.score <= 1 for r in got)
