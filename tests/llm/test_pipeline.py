import random

import pytest

import corpus_pipeline as P
from rill.llm import decontaminate as D
from rill.llm import jaccard as J
from rill.llm.common import hadoop_path, shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("stone", "river", "light", "garden", "winter", "paper", "cloud", "metal") for b in ("s", "ing", "ed", "er", "ly", "less", "ness")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(3)
    folder = tmp_path_factory.mktemp("corpus")
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    item = text(14)
    rows, labels = [], []
    for i in range(160):
        good = i % 5 != 0
        t = text(rnd.randint(20, 90))
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split())))
        labels.append((i, int(good), 0))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " added"), (202, f"{text(20)} {item} {text(5)}"), (203, "12 34 56"), (204, None), (205, ""), (206, text(9000)), (1, rows[1][1])]
    table = [(i, t, "en" if i % 7 else None, f"src{i % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), table


def test_stages_one_by_one(spark, corpus):
    folder, table = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
    ids = lambda s: {i for i, _ in s}
    readable = {r[0] for r in table} - {203, 204, 205}
    assert ids(kept[0]) == readable
    bad = {i for i in range(0, 160, 5)}
    assert ids(kept[1]) == readable - bad
    classes = J.brute_force(sorted(kept[1]))
    assert ids(kept[2]) == {i for i, (c, _) in classes.items() if c == i} and not ids(kept[2]) & {200, 201}
    clean = {r[0] for r in D.brute_force(sorted(kept[2]), [(1, spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text)]) if not r[5]}
    assert ids(kept[3]) == clean and 202 not in clean and 206 in clean


def left(spark, before=()):
    """Kinds of tables in the shared folder, by what is there now and was not before."""
    at, fs = hadoop_path(spark, shared_folder(spark))
    now = {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()
    return now, {x.rpartition("-")[0] for x in now - set(before) if "-" in x}


def test_deciding_stages_leave_no_tables_but_their_decisions(spark, corpus, monkeypatch):
    """Large clusters and blocks of the benchmark too; the result comes from what is left."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 2)
    folder, table = corpus
    docs = spark.createDataFrame([*table, *((300 + i, table[6][1] + f" {w}", "en", "s", 0) for i, w in enumerate(WORDS[:8]))], DOCS)
    before, _ = left(spark)
    kept = J.keep_one(docs)
    middle, kinds = left(spark, before)
    assert kinds == {"gone", "chosen"}
    clean = D.keep_clean(kept, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert left(spark, middle)[1] == {"gone"}
    ids = sorted(r.doc_id for r in clean.collect())
    assert not {*ids} & {200, 201, 202, *range(300, 308)} and {1, 2, 6, 203, 204, 205, 206} <= {*ids} and len(ids) == len(set(ids))


def test_run_leaves_one_table_of_documents(spark, corpus):
    before, _ = left(spark)
    assert P.run(spark, corpus[0]).count()
    names = {n.replace(" ", "-") for n, _ in P.STAGES}
    assert left(spark, before)[1] & names == {P.STAGES[-2][0].replace(" ", "-")}


def test_run_packs_what_is_kept(spark, corpus):
    folder, _ = corpus
    got = P.run(spark, folder).collect()
    bins = {}
    for r in got:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 4096 and {r.doc_id for r in got if r.piece == 1} == {206}


def test_stages_take_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
