"""Language identification by Bayesian evidence fusion.

Evidence for each row: the likelihood of its text under a smoothed byte n-gram model of each language; the language that
its mark-up declares; the suffix of its address; and a prior of its host, smoothed towards its domain and that towards
all rows. Every label that occurs gets a model, fitted on a bounded sample of its distinct texts. The reliability of each
declaration and suffix and the priors come from all rows, by grouped sums of the text evidence: one row for each value or
host, whatever its number of pages. A row's own text is taken out of its host's sums, so it does not count twice.

Log posterior of a language = TEMPER * log likelihood + log P(declared | language) + log P(suffix | language)
+ log prior(host), all in column expressions.

Defined results: ``und`` (rejected) where the share of n-grams that the best language knows is below LEAST_KNOWN, as for
null, empty or letterless texts and for other scripts, or where no language reaches LEAST_CONFIDENCE; a missing
declaration, suffix or host is a value of its own; ties go to the language that comes first by name; with no labelled
texts all rows are ``und``; pages and texts of any length are read whole in time that grows with them; repeated rows get a
row each, equal but for what the other copies add to their host; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_among, looked_up, settled, ship, slices, stored, text_key, utf8, without
from .toxicity import LOWER

GRAM, TABLE_BITS = 4, 18
#: Bound of the labelled sample: about so many distinct texts of each language.
ROWS_EACH = 400
#: n-grams overlap, so a text's likelihood counts for less than its length.
TEMPER = 0.1
#: Weight of the parent in a smoothed prior, in rows.
HOST_ROWS, DOMAIN_ROWS = 8.0, 20.0
LEAST_KNOWN, LEAST_CONFIDENCE = 0.35, 0.5
CALL_BYTES = 1_000_000
#: A call's rows times its languages.
CALL_CELLS = 1 << 20


def grams(b: bytes) -> np.ndarray:
    """Table places of the byte n-grams of a lower-cased text between spaces."""
    a = np.frombuffer(b" " + b.translate(LOWER) + b" ", np.uint8).astype(np.uint32)
    if len(a) < GRAM:
        return np.empty(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint32)
    for j in range(GRAM):
        h = (h << np.uint32(8)) | a[j : len(a) - GRAM + 1 + j]
    h *= np.uint32(2654435761)
    return (h >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def pack_counts(texts: list[str]) -> bytes:
    """How often the n-grams of texts fall on each place of the table, compressed: places are stored as differences."""
    counts = np.zeros(1 << TABLE_BITS, np.int64)
    for t in texts:
        g = grams(utf8(t))
        if len(g):
            counts += np.bincount(g, minlength=len(counts))
    places = np.flatnonzero(counts)
    return zstandard.ZstdCompressor(level=3).compress(np.diff(places, prepend=0).astype("<i4").tobytes() + counts[places].astype("<i8").tobytes())


class TextModel:
    """Log probabilities of n-grams for each language; sums over a text are its log likelihoods.

    Counts stay packed, so that a language takes the room of the n-grams it has; one language's table is laid out at a time."""

    SMOOTH = 0.1

    def __init__(self, packed: dict[str, bytes]):
        self.names = sorted(packed)
        self.packed = [packed[name] for name in self.names]

    def counts(self, k: int) -> np.ndarray:
        body = zstandard.ZstdDecompressor().decompress(self.packed[k])
        n = len(body) // 12
        out = np.zeros(1 << TABLE_BITS, np.float32)
        out[np.cumsum(np.frombuffer(body, "<i4", n))] = np.frombuffer(body, "<i8", n, 4 * n)
        return out

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (a row for each text) and the share of n-grams that the likeliest language knows."""
        out, share = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        if not self.names or not texts:
            return out, share
        own = [grams(t) if t.strip() else np.empty(0, np.int64) for t in texts]
        n = np.array([len(g) for g in own])
        some = np.flatnonzero(n)
        if not len(some):
            return out, share
        at, first = np.concatenate(own), (np.cumsum(n) - n)[some]
        for k in range(len(self.names)):
            c = self.counts(k)
            logs = np.log((c + self.SMOOTH) / (c.sum() + self.SMOOTH * len(c)))
            out[some, k] = np.add.reduceat(logs[at], first, dtype=np.float64)
        best, knows = np.repeat(out.argmax(axis=1), n), np.zeros(len(at), bool)
        for k in np.unique(best):
            of = best == k
            knows[of] = (self.counts(k) > 0)[at[of]]
        share[some] = np.add.reduceat(knows, first, dtype=np.float64) / n[some]
        letters = np.array([bool(LETTER.search(t)) for t in texts])
        return out, np.where(letters, share, 0.0)


LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
#: Hidden parts begin with a comment's or one of these elements' opening and end with its closing.
OPENING = re.compile(r"<!--|<(script|style|nav|head|header|footer|aside)\b", re.I)
CLOSING = {"": re.compile("-->")} | {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "nav", "head", "header", "footer", "aside")}
ROOT, LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*+=\s*+[\"']?+\s*+([A-Za-z]+)", re.I)
TAG = re.compile(r"<[^>]*>")
LONG_REFERENCE = re.compile(r"&#([0-9]{9,});?")
HOST = re.compile(r"^\s*+(?:[a-z][a-z0-9+.-]*+:)?//(?:[^/?#@]*+@)?([^/?#:\s]+)", re.I)


def visible_text(page: str | None) -> str:
    """What a page shows: no mark-up, scripts, styles, navigation or comments. Parts that are not closed are shown.

    One pass from left to right: what is missing once further on is not looked for again, so time grows with the page."""
    page, parts, at, unclosed = page or "", [], 0, set()
    for m in OPENING.finditer(page):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in unclosed:
            continue
        end = CLOSING[kind].search(page, m.end())
        if end is None:
            unclosed.add(kind)
            continue
        parts.append(page[at : m.start()])
        at = end.end()
    text = " ".join([*parts, page[at:]])
    last = text.rfind(">") + 1  # beyond it no tag ends
    text = TAG.sub(" ", text[:last]) + text[last:]
    text = LONG_REFERENCE.sub(lambda r: f"&#{(r[1].lstrip('0') or '0')[:9]};", text)
    return " ".join(html.unescape(text).split())


def declared_language(page: str | None) -> str:
    """The language that an <html> tag declares, "" for none."""
    page, at = page or "", 0
    while m := ROOT.search(page, at):
        at = page.find(">", m.end())
        at = len(page) if at < 0 else at
        if found := LANG.search(page, m.end(), at):
            return found[1].lower()
    return ""


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower().rstrip(".") if m else ""


def labelled_model(docs: DataFrame, label: str, text: str = "text") -> TextModel:
    """A text model of every language in ``label``, each fitted on a bounded sample of its distinct texts in docs. The
    driver holds the packed counts of each language and no texts."""
    ship(docs.sparkSession)
    known = docs.select(F.lower(F.trim(F.col(label).cast("string"))).alias("lang"), F.col(text).alias("text"))
    known = known.where("lang is not null and lang <> '' and text is not null")
    own = stored(known.groupBy("lang").agg(F.approx_count_distinct("text").alias("texts")), "labels")
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(own), "lang").where(draw < ROWS_EACH / F.col("texts"))

    def fit(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            packed = [pack_counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["lang", "packed"])

    fitted = sample.groupBy("lang").agg(F.collect_set("text").alias("texts")).mapInArrow(lambda batches: settled(fit(batches)), "lang string, packed binary")
    return TextModel({r["lang"]: bytes(r["packed"]) for r in fitted.collect()})


def text_evidence(rows: DataFrame, model: TextModel, pages: bool) -> DataFrame:
    """rows (id, text, declared, url) -> id, lik (tempered log likelihoods), own (their shares; zero where the text
    is not known), known, declared, host, domain, suffix, key (of the text).

    pages: text is a web page, which also declares its language."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = rows.select("id", "text", "declared", "url", text_key(F.col("text")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]):
        m = pickle.loads(held.value)
        most = max(1, CALL_CELLS // max(1, len(m.names)))
        for b in (part.slice(i, most) for part in slices(batches, 1, CALL_BYTES) for i in range(0, part.num_rows, most)):
            texts, declared, urls = (b.column(i).to_pylist() for i in range(1, 4))
            said = [declared_language(t) for t in texts] if pages else [(d or "").strip().lower() for d in declared]
            hosts = [host_of(u) if pages else u or "" for u in urls]
            lik, known = m.evidence([utf8(visible_text(t) if pages else t or "") for t in texts])
            lik = TEMPER * lik
            own = np.exp(lik - lik.max(axis=1, keepdims=True, initial=-np.inf))
            own *= (known >= LEAST_KNOWN)[:, None] / own.sum(axis=1, keepdims=True)
            labels = [h.split(".") for h in hosts]
            columns = [
                b.column(0),
                pa.array(list(lik), pa.list_(pa.float64())),
                pa.array(list(own), pa.list_(pa.float64())),
                pa.array(known),
                pa.array(said),
                pa.array(hosts),
                pa.array([".".join(x[-2:]) for x in labels]),
                pa.array([x[-1] if len(x) > 1 else "" for x in labels]),
                b.column(4),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lik", "own", "known", "declared", "host", "domain", "suffix", "key"])

    return rows.mapInArrow(
        lambda batches: settled(run(batches)), "id bigint, lik array<double>, own array<double>, known double, declared string, host string, domain string, suffix string, key bigint"
    )


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sums(k: int, array: str) -> Column:
    """The sum of arrays, place by place."""
    return F.array(*[F.coalesce(F.sum(F.col(array)[i]), F.lit(0.0)) for i in range(k)])


def fuse(seen: DataFrame, names: list[str]) -> DataFrame:
    """id, lang, confidence, text_lang, declared, host and text key of every row of stored text evidence."""
    if not names:
        und = F.lit("und")
        return seen.select("id", und.alias("lang"), F.lit(0.0).alias("confidence"), und.alias("text_lang"), "declared", "host", "key")
    k = len(names)
    total_rows = seen.count()
    hosts = stored(seen.groupBy("host", "domain").agg(sums(k, "own").alias("at_host"), F.count("*").alias("rows")), "hosts")
    hot = hot_among(hosts.select("host", "rows"), "host", total_rows)
    all_ = np.array(hosts.agg(sums(k, "at_host")).first()[0])
    base = F.array(*[F.lit(float(x)) for x in DOMAIN_ROWS * (all_ + 1.0) / (all_ + 1.0).sum()])
    domains = hosts.groupBy("domain").agg(sums(k, "at_host").alias("at_domain")).select("domain", plus(F.col("at_domain"), base).alias("at_domain"))
    total = F.aggregate("at_domain", F.lit(0.0), lambda a, x: a + x)
    parents = domains.select("domain", total.alias("total"), "at_domain")
    parents = parents.select("domain", F.transform("at_domain", lambda x: HOST_ROWS * x / F.col("total")).alias("parent"))
    # One row for each host and domain.
    hosts = hosts.join(parents, "domain").select("host", "at_host", "parent")
    joined = seen.withColumn("score", F.col("lik"))
    for name in ("declared", "suffix"):
        given, often = reliability(seen, name, all_, total_rows)
        joined = looked_up(joined, name, given, often, "id").withColumn("score", plus(F.col("score"), F.col("given"))).drop("given")
    joined = looked_up(joined, "host", hosts, hot, "id")
    # The host's sums without the row itself. What all languages' priors are divided by cancels.
    rest = F.zip_with("at_host", "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    joined = joined.withColumn("post", F.zip_with("score", plus(rest, F.col("parent")), lambda x, p: x + F.log(p)))
    joined = joined.withColumn("top", F.array_max("post"))
    share = 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    joined = joined.withColumn("share", F.when(F.col("known") >= LEAST_KNOWN, share).otherwise(0.0))
    lang = F.array(*map(F.lit, names))
    first = lambda c, top: lang[F.array_position(c, top).cast("int") - 1]
    return joined.select(
        "id",
        F.when(F.col("share") >= LEAST_CONFIDENCE, first("post", F.col("top"))).otherwise("und").alias("lang"),
        F.col("share").alias("confidence"),
        F.when(F.col("known") >= LEAST_KNOWN, first("lik", F.array_max("lik"))).otherwise("und").alias("text_lang"),
        "declared",
        "host",
        "key",
    )


def reliability(seen: DataFrame, name: str, total: np.ndarray, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """log P(value | language) as ``given``, a row for each value that occurs, and the values of very many rows. total: the sums of
    all rows."""
    groups = stored(seen.groupBy(name).agg(sums(len(total), "own").alias("sums"), F.count("*").alias("rows")), name)
    size = F.array(*[F.lit(float(x)) for x in total + 0.5 * (groups.count() + 1)])
    given = groups.select(name, F.zip_with("sums", size, lambda c, n: F.log((c + 0.5) / n)).alias("given"))
    return given, hot_among(groups.select(name, "rows"), name, rows)


def identify(rows: DataFrame, model: TextModel, pages: bool) -> DataFrame:
    """rows (id, text, declared, url) -> id, lang, confidence, text_lang, declared, host, key (of the text)."""
    return fuse(stored(text_evidence(rows, model, pages), "evidence"), model.names)


def identify_pages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(page).alias("text"), F.lit(None).cast("string").alias("declared"), F.col(url).alias("url")
    )
    return identify(rows, model, pages=True).drop("key").withColumnRenamed("id", page_id)


def keep_identified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source"
) -> DataFrame:
    """docs without the rows whose language cannot be told, by models fitted on docs' own declarations."""
    model = labelled_model(docs, declared, text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).alias("text"),
        F.col(declared).cast("string").alias("declared"),
        F.col(host).cast("string").alias("url"),
    )
    found = identify(rows, model, pages=False)
    return without(docs, found.where("lang = 'und'").select("id", "key"), doc_id, text)
