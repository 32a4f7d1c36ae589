import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rill.llm import common as C


def test_words():
    assert C.words_of("Ab-c d'É x9\tÖ_ü!") == ["ab".encode(), b"c", b"d", "É".encode(), b"x9", "Ö".encode(), "ü".encode()]
    assert C.words_of(None) == C.words_of(" .,!") == []


def test_slices_cover_batches_in_order():
    rnd = random.Random(1)
    texts = [None if rnd.random() < 0.1 else "é" * rnd.choice([0, 3, 40, 900]) for _ in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["i", "t"])
    parts = list(C.slices(iter([b, b.slice(5, 7)]), 1, 500))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(300), *range(5, 12)]
    for p in parts:
        assert len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 500


def test_shingles_of_short_texts():
    codes = C.word_codes([b"a", b"b", b"c"])
    assert len(C.shingle_hashes(codes, 5)) == 1 and len(C.shingle_hashes(codes, 3)) == 1 and len(C.shingle_hashes(codes, 2)) == 2
    assert len(C.shingle_hashes(codes[:0], 5)) == 0
    same = C.shingle_hashes(C.word_codes([b"a", b"b", b"a", b"b", b"a"]), 2)
    assert same[0] == same[2] != same[1] and len(np.unique(same)) == 2


def test_without_tells_rows_of_an_id_apart(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (3, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id int, text string, key int")
    gone = df.where("key in (0, 3, 5)").select(F.col("doc_id").cast("long").alias("id"), C.text_key(F.col("text")).alias("key"))
    kept = C.without(df, gone, "doc_id", "text")
    assert kept.columns == df.columns and sorted(r.key for r in kept.collect()) == [1, 2, 4]
    assert C.without(df, gone.limit(0), "doc_id", "text").count() == 6


def test_flags_miss_nothing_listed(spark):
    df = spark.range(5000)
    listed = df.where("id % 7 = 0")
    seen = C.flagged(df, listed, ["id"], "maybe")
    assert seen.where("not maybe and id % 7 = 0").count() == 0
    assert seen.where("maybe and id % 7 > 0").count() < 20


def test_ranks_are_gapless(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(0))
    got = C.ranked(df, ["g"], ["id"], "rank", 3000, per_bucket=100).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r["rank"])
    assert len(got) == 3000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stored_tables_can_go(spark):
    t = C.stored(spark.range(5), "t")
    assert t.count() == 5
    C.discard(t)
    from pathlib import Path

    assert not Path(t._stored_at.removeprefix("file:").replace("//", "/")).exists()
