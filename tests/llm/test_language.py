import random

import numpy as np
import pytest

from rill.llm import language as L

WORDS = {"aa": ["kala", "talo", "mina", "sinun", "kissa"], "bb": ["the", "house", "with", "wind", "other"], "cc": ["сло", "дом", "река", "поле", "мир"]}


def text(lang, rnd, n=30):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def docs(n=120, seed=1):
    rnd = random.Random(seed)
    return [(i, text(x, rnd), x, f"s{i % 5}") for i in range(n) for x in [rnd.choice(["aa", "bb"])]]


def test_pages_fuse_evidence(spark):
    rnd = random.Random(2)
    d = spark.createDataFrame(docs(), "doc_id long, text string, lang string, source string")
    model = L.labelled_model(d, "lang")
    page = lambda lang, body: f"<!doctype html><HTML class=x lang='{lang}-XX'><head><title>q</title></head><body><!-- {text('bb', rnd)} --><script>{text('bb', rnd)}</script><p>{body}</p></body></html>"
    rows, want = [], {}
    for i in range(90):
        x = rnd.choice(["aa", "bb"])
        rows.append((i, f"https://user@www.{x}site.{x}:80/p?q#f", page(x, text(x, rnd))))
        want[i] = x
    rows += [(100, "//www.aasite.aa/", page("aa", "talo the")), (101, None, page("zz", text("cc", rnd))), (102, None, None), (103, "", ""), (104, "x", "<p>123 456</p>")]
    rows += [(5, "http://www.bbsite.bb", page("bb", text("bb", rnd)))]
    want |= {100: "aa", 101: "und", 102: "und", 103: "und", 104: "und"}
    p = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "page_id long, url string, html string, lang string, known double")
    got = L.identify_pages(p, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id != 5:
            assert r.lang == want[r.page_id], r
            assert (r.lang == "und") == (r.confidence < 0.5)
    assert L.identify_pages(p.limit(0), model).count() == 0


def test_posterior_equals_brute_force(spark):
    """The fused scores from the formulas, row by row in Python."""
    rnd = random.Random(5)
    model = L.labelled_model(spark.createDataFrame(docs(), "doc_id long, text string, lang string, source string"), "lang")
    rows = [(i, text(rnd.choice(["aa", "bb"]), rnd, rnd.choice([1, 3, 20])), rnd.choice(["aa", "bb", "", None]), rnd.choice(["a.x.aa", "b.x.aa", "c.y.bb", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, url string")
    got = {r.id: r for r in L.identify(df, model, pages=False).collect()}
    lik, known = model.evidence([t.encode() for _, t, _, _ in rows])
    e = np.exp(L.TEMPER * lik - (L.TEMPER * lik).max(axis=1, keepdims=True))
    own = np.where((known >= L.LEAST_KNOWN)[:, None], e / e.sum(axis=1, keepdims=True), 0)
    said, hosts = [r[2] or "" for r in rows], [r[3] or "" for r in rows]
    suffix = [h.split(".")[-1] if "." in h else "" for h in hosts]
    domain = [".".join(h.split(".")[-2:]) for h in hosts]
    total = own.sum(axis=0)
    base = (total + 1) / (total + 1).sum()
    for i, r in enumerate(rows):
        s = L.TEMPER * lik[i]
        for values in (said, suffix):
            same = np.array([v == values[i] for v in values])
            s = s + np.log((own[same].sum(axis=0) + 0.5) / (total + 0.5 * (len(set(values)) + 1)))
        d = own[[x == domain[i] for x in domain]].sum(axis=0) + L.DOMAIN_ROWS * base
        h = np.maximum(own[[x == hosts[i] for x in hosts]].sum(axis=0) - own[i], 0) + L.HOST_ROWS * d / d.sum()
        s = s + np.log(h / h.sum())
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert abs(got[i].confidence - p.max()) < 1e-9 and got[i].lang == model.names[p.argmax()]


def test_stage_keeps_columns_and_readable_rows(spark):
    own = docs() + [(500, "12 34 !!", "aa", "s1"), (501, None, None, None), (502, "", "bb", "s2"), (503, text("bb", random.Random(1)), None, None)]
    d = spark.createDataFrame(own, "doc_id long, text string, lang string, source string")
    kept = L.keep_identified(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in own} - {500, 501, 502}
    assert L.keep_identified(d.limit(0)).count() == 0


def test_every_language_and_value_counts(spark):
    """More languages than any cap: each declared one is found, and rare declarations have a reliability of their own."""
    rnd = random.Random(9)
    words = {f"l{i:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(45)}
    made = lambda x, n: " ".join(rnd.choice(words[x]) for _ in range(n))
    own = [(x, made(x, 30)) for i, x in enumerate(words) for _ in range(3 if i else 20)]
    own += [("copied", "одна строка текста")] * 12000  # one text of a label that has many rows
    d = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(own)], "doc_id long, text string, lang string")
    model = L.labelled_model(d, "lang")
    assert model.names == sorted([*words, "copied"])
    said = lambda i, x: "rare" if i < 3 else f"v{i}" if i < 2100 else x
    rows = [(i, made(x, 8 if i >= 3 else 1), said(i, x), None) for i in range(2500) for x in ["l44" if i < 3 else f"l{i % 45:02}"]]
    got = {r.id: r for r in L.identify(spark.createDataFrame(rows, "id long, text string, declared string, url string"), model, pages=False).collect()}
    assert all(got[i].lang == f"l{i % 45:02}" for i in range(3, 2500))
    lik, known = model.evidence([r[1].encode() for r in rows])
    e = np.exp(L.TEMPER * (lik - lik.max(axis=1, keepdims=True)))
    own = np.where((known >= L.LEAST_KNOWN)[:, None], e / e.sum(axis=1, keepdims=True), 0)
    values = [r[2] for r in rows]
    total = own.sum(axis=0)
    rest = total + L.HOST_ROWS * (total + L.DOMAIN_ROWS * (total + 1) / (total + 1).sum()) / (total.sum() + L.DOMAIN_ROWS)
    for i in (0, 3, 2000, 2400):
        of = own[[v == values[i] for v in values]].sum(axis=0)
        s = L.TEMPER * lik[i] + np.log((of + 0.5) / (total + 0.5 * (len(set(values)) + 1))) + np.log((total + 0.5) / (total + 1)) + np.log(rest - own[i])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert abs(got[i].confidence - p.max()) < 1e-9


@pytest.mark.parametrize("piece", ["<!--", "<script ", "<html ", "<", "</script", "lang=", "<html lang=" + " " * 50, "&#9", "&#" + "9" * 5000 + ";", "<head><!-- -->", "//", "a:"])
def test_long_odd_pages_take_time_in_proportion(piece):
    import time

    page = piece * (4_000_000 // len(piece))
    began = time.process_time()
    L.visible_text(page), L.declared_language(page), L.host_of(page)
    assert time.process_time() - began < 10


def test_hidden_parts_and_declarations():
    page = "<!doctype html><HEAD>t</head><header>h</header >a<!-- <p> -->b<script>x</script>c<style>s</STYLE>d<nav>e"
    assert L.visible_text(page) == "a b c d e"
    assert L.visible_text("<!-- never closed <p>x</p> &amp; <script>y</script> 1 < 2") == "<!-- never closed x & 1 < 2".replace("<!-- never closed ", "")
    assert L.visible_text("&#65;&#0000000000066;&#" + "9" * 6000 + ";&lt;") == "AB\ufffd<"
    for tag, want in (("<html lang=de>", "de"), ("<HTML class='x' LANG = 'pt-BR'>", "pt"), ("<html><p lang=de>", ""), ("<htmlx lang=de>", ""), ("<html lang=>", ""), ("<html a><html lang=fr", "fr")):
        assert L.declared_language(tag) == want, tag


def test_hot_hosts_are_dealt(spark, monkeypatch):
    """Many rows of one host and one declaration: the same result as with no key taken for hot."""
    from rill.llm import common

    rnd = random.Random(11)
    model = L.labelled_model(spark.createDataFrame(docs(), "doc_id long, text string, lang string, source string"), "lang")
    rows = [(i, text(rnd.choice(["aa", "bb"]), rnd, 3), "aa" if i % 3 else "bb", "hot.x.aa" if i % 4 else f"h{i}.y.bb") for i in range(200)]
    df = spark.createDataFrame([*rows, rows[0], (300, None, None, None)], "id long, text string, declared string, url string")
    plain = sorted(map(tuple, L.identify(df, model, pages=False).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    assert sorted(map(tuple, L.identify(df, model, pages=False).collect())) == plain and len(plain) == 202


def test_ties_go_to_the_first_name(spark):
    own = [(i, "same words here", x, "s") for i, x in enumerate(["bb", "aa"] * 20)]
    model = L.labelled_model(spark.createDataFrame(own, "doc_id long, text string, lang string, source string"), "lang")
    rows = spark.createDataFrame([(1, "same words here", None, None)], "id long, text string, declared string, url string")
    assert [(r.lang, r.text_lang) for r in L.identify(rows, model, pages=False).collect()] == [("aa", "aa")]


def test_given_pages(spark, small):
    from rill.llm.registry import op8_language_fusion

    got = op8_language_fusion(spark, small).collect()
    assert np.mean([r.lang == r.declared for r in got]) >= 0.96


@pytest.mark.parametrize("url, host", [("http://A.b.Com/x", "a.b.com"), ("https://u:p@h.org:8/", "h.org"), ("nonsense", ""), (None, ""), ("//h.de?x", "h.de")])
def test_hosts(url, host):
    assert L.host_of(url) == host
