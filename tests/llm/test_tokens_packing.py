import random
import zlib

import numpy as np
import pytest

from rill.llm import packing as P
from rill.llm import tokens as K
from rill.llm.common import tokenizer_path

ALPHABET = list("abZªµÉéñß 's.,!?'-<|>1२٣\n\t  ́\x1f漢字😀İΣσ") + [" the ", "ing", "<|endoftext|>", "'re ", "...", "  ", "word, "]


def made(n, seed, most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("most", [300_000, 50])
def test_chunks_encode_as_the_library_does(most, spark, small):
    texts = made(3000, 1) + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    e = K.WordEncoder("word_bpe_49k.json", most)
    for i in range(0, len(texts), 500):
        assert e.encode(texts[i : i + 500]) == e.encode_plain(texts[i : i + 500])


def test_counts_equal_the_library_and_long_texts_split_safely(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = made(300, 2) + ["ab cd  ef " * 300, "x" * 5000, "", "  lead and  two", "a b " * 2000 + "<s> </s> tail "]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (1, texts[1])]
    want = sorted((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in docs)
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, n_tokens int, n_bytes int")
    assert sorted(tuple(r) for r in K.count_tokens(df, "piece_bpe_32k.model").collect()) == want
    for t in texts:
        for most in (5, 50):
            assert sum(len(sp.encode(x)) for x in K.split_safely(t, most)) == len(sp.encode(t))
    assert K.count_tokens(df.limit(0), "piece_bpe_32k.model").count() == 0


def test_fullest_is_a_largest_subset_sum():
    rnd = random.Random(4)
    for _ in range(200):
        room = rnd.randint(1, 60)
        items = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        sums = {0}
        for n, c in items.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        chosen = P.fullest(sorted(items.items(), reverse=True), room)
        assert sum(n * k for n, k in chosen) == max(sums) and all(k <= items[n] for n, k in chosen)


def test_plan_places_everything_once():
    rnd = random.Random(5)
    counts = {rnd.randint(1, 100): rnd.randint(1, 500) for _ in range(60)}
    plan = P.plan_bins(counts, 100)
    used = {}
    for times, chosen in plan:
        assert sum(n * k for n, k in chosen) <= 100
        for n, k in chosen:
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for t, _ in plan) <= total / 100 * 1.05 + 1


def test_round_trip(spark, small):
    e = K.WordEncoder("word_bpe_49k.json")
    docs = [(i, t) for i, t in enumerate(made(150, 6, 200))] + [(500, None), (501, ""), (3, "again"), (502, "word ate " * 5000)]
    df = spark.createDataFrame([(*x, 0, 0) for x in docs], "doc_id long, text string, offset int, length int")
    got = P.pack(df, limit=256).collect()
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.sequence_id, []).append(r)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    want = []
    for i, t in docs:
        ids = e.encode_plain([t or ""])[0] + np.array([1], "<u4").tobytes()
        parts = [ids[k : k + 1024] for k in range(0, len(ids), 1024)]
        want += [(i, k, 256 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert P.pack(df.limit(0)).count() == 0
