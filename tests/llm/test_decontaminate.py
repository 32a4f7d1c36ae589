import random

import pytest

from rill.llm import decontaminate as D

DOCS = "doc_id long, text string, lang string, item_id string"
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def made(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "x9", "the"]
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, text(rnd.choice([3, 9, 12, 25]))) for i in range(8)] + [(8, None), (9, ""), (10, "w1"), (3, text(11))]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(30)]
    docs += [(30 + i, f"{text(20)} {t} {text(5)}") for i, (_, t) in enumerate(items) if t]
    return docs + [(90, None), (91, ""), (92, "!!"), (7, docs[7][1]), (7, text(30))], items


@pytest.mark.parametrize("block_bytes", [10**7, 200])
def test_rows_equal_brute_force(spark, block_bytes):
    docs, items = made()
    d = spark.createDataFrame([(*x, "en", "clash") for x in docs], DOCS)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = D.digest(D.find_contamination(d, b, window=10, block_bytes=block_bytes))
    assert rows(found) == sorted(D.brute_force(docs, items))


def test_tables_without_rows(spark):
    d = spark.createDataFrame([(1, "a b c", "en", "")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.digest(D.find_contamination(d, none)))[0][:4] == (1, 3, 0, 0)
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert rows(D.digest(D.find_contamination(d.limit(0), b))) == []


def test_proximity_allows_a_word_between(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, item), (2, item.replace("five", "five odd")), (3, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = {r.doc_id: r for r in D.find_contamination(d, b, slop=2).collect()}
    assert [(found[i].items, found[i].near_items) for i in (1, 2, 3)] == [(["5"], ["5"]), ([], ["5"]), ([], [])]


@pytest.mark.parametrize("block_bytes", [10**7, 200])
def test_items_without_id(spark, block_bytes):
    """They hit, and count as one item, as in the SQL."""
    import duckdb

    from rill.llm.registry import OP1_SQL

    docs, items = made(4)
    items += [(None, " ".join(f"n{i}" for i in range(12))), (None, "only here"), (None, None)]
    docs += [(200, f"x {items[-3][1]} y"), (201, "only here"), (202, f"only here {items[-3][1]}"), (203, f"{items[1][1]} only here")]
    docs = [(i, t) for i, (_, t) in enumerate(docs) if t is not None]  # the SQL joins on doc_id and has no words of a null text
    d = spark.createDataFrame([(*x, "en", "clash") for x in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(d, b, window=10, block_bytes=block_bytes)
    got = rows(D.digest(found))
    documents, benchmark = (x.toArrow() for x in (d.select("doc_id", "text"), b))
    con = duckdb.connect()
    con.register("documents", documents), con.register("benchmark", benchmark)
    assert got == sorted(D.brute_force(docs, items)) == sorted(con.sql(OP1_SQL).fetchall())
    kept = {r.doc_id for r in D.keep_clean(d, b).collect()}
    assert kept == {r[0] for r in got if not r[5]} and not kept & {i for i, (_, t) in enumerate(docs) if "only here" in t}


def test_keep_clean_judges_rows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "clean"), (1, item), (None, f"x {item}"), (None, None), (2, "")]
    d = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, key string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = D.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(map(str, d.where("text is null or text in ('clean', '')").collect()))


def test_given_tables(spark, small):
    from rill.llm.registry import op1_decontamination

    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(op1_decontamination(spark, small)) == sorted(D.brute_force(docs, items))


def test_one_index_for_all_blocks(spark, monkeypatch):
    """However many blocks a benchmark has, texts are cut into words once, and lists hold every word."""
    docs, items = made(5)
    built = []
    build = D.build_index
    monkeypatch.setattr(D, "build_index", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    d = spark.createDataFrame([(*x, "en", "clash") for x in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = D.digest(D.find_contamination(d, b, window=10, block_bytes=100))
    assert rows(found) == sorted(D.brute_force(docs, items)) and len(built) == 1
    words = sorted(w for _, t in docs for w in D.words_of(t))
    codes = {w: D.word_codes([w]) for w in {*words, b"absent"}}
    counts = {w: sum(len(D.unpack_postings(r.postings, c)[1]) for r in built[0].collect()) for w, c in codes.items()}
    assert counts == {w: words.count(w) for w in codes}


def test_very_long_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_BYTES", 300)
    docs, items = made(6)
    long = " ".join(t or "" for _, t in docs * 3)
    docs = [*docs, (500, long), (501, f"{long} {items[2][1]}")]
    d = spark.createDataFrame([(*x, "en", "") for x in docs], DOCS)
    found = D.digest(D.find_contamination(d, spark.createDataFrame(items, "item_id long, text string")))
    assert rows(found) == sorted(D.brute_force(docs, items))
