"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document. Every row is a segment: some whole documents (at most ``SEGMENT_BYTES`` of text,
or one longer document) and, for each word that they hold, a 64-bit code and the ascending list of its positions in the segment. Building it
needs no shuffle and no frequent term gathers anywhere. Positions of consecutive documents are a gap apart that no
window can bridge. The index is a stored table of all words, made in one pass over the texts whatever is searched for; searches read
it and never the texts.

A search takes each benchmark window's terms from the rarest in the segment to the most frequent, starts from the
rarest one's positions less its offset in the window, and intersects with each further list less its own offset. A
window with a term that the segment lacks costs nothing. Proximity matches come from the same lists, each allowed to
be off by up to ``slop`` words.

Benchmarks are sent to executors in blocks of at most ``BLOCK_BYTES`` of text, so that what is broadcast is bounded;
all blocks search the one index, and results of blocks are merged by document row.

Defined results: a null or empty text has no words and no hits; a null item text has no windows; items with the same id
count as one, and so do all items without an id: their windows hit as any others, they count as one more item, null in
lists of ids and left out of the digest of ids; repeated documents give repeated rows; a very long document is a segment of its own,
searched whole; windows that overlap or tie share their words, each counted once; an empty table of documents gives an empty table; an empty
benchmark leaves every document clean. Two different words have the same code with a chance of one in 2^64.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, ship, short_lived, slices, stored, text_key, without, word_codes, words_of

SEGMENT_BYTES = 2_000_000
BLOCK_BYTES = 8_000_000
#: Lists are intersected for so many candidates at a time.
CANDIDATES = 2_000_000

_INDEX = pa.schema(
    [(n, pa.list_(pa.int64())) for n in ("doc_ids", "keys", "lengths")] + [("postings", pa.binary())]
)
_INDEX_DDL = "doc_ids array<bigint>, keys array<bigint>, lengths array<bigint>, postings binary"
_MATCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("key", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.list_(pa.int64()))),
        ("items", pa.list_(pa.string())),
        ("near_items", pa.list_(pa.string())),
    ]
)
_MATCH_DDL = (
    "doc_id bigint, key bigint, n_words bigint, spans array<array<bigint>>, items array<string>, near_items array<string>"
)


class Windows:
    """A block of a benchmark: the codes of its terms, and its windows as term numbers, grouped by their length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        terms: dict[bytes, int] = {}
        rows: dict[int, dict[tuple, set[str | None]]] = {}
        for item, text in items:
            codes = [terms.setdefault(w, len(terms)) for w in words_of(text)]
            n = min(window, len(codes))
            for i in range(len(codes) - n + 1 if n else 0):
                rows.setdefault(n, {}).setdefault(tuple(codes[i : i + n]), set()).add(item)
        self.terms = word_codes(list(terms))
        self.names = sorted({i for r in rows.values() for s in r.values() for i in s}, key=lambda x: (x is None, x or ""))
        number = {x: i for i, x in enumerate(self.names)}
        #: length -> (windows as term numbers, the items that hold each)
        self.groups = {
            n: (np.array(list(r), np.int64).reshape(-1, n), [sorted(number[x] for x in s) for s in r.values()])
            for n, r in rows.items()
        }


def pack_postings(codes: np.ndarray, positions: np.ndarray) -> bytes:
    """Postings in the order of (code, position): codes, where their lists start, and positions as differences, compressed."""
    order = np.argsort(codes, kind="stable")
    found, start = np.unique(codes[order], return_index=True)
    p = positions[order]
    gaps = np.diff(p, prepend=0)
    gaps[start] = p[start]
    heads = np.array([len(p), len(found)], "<i8").tobytes()
    body = heads + found.astype("<u8").tobytes() + start.astype("<i8").tobytes() + gaps.astype("<i4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_postings(blob: bytes, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the term, position) of the lists of some terms, given by their codes, in that order."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, k = (int(x) for x in np.frombuffer(body, "<i8", 2))
    found = np.frombuffer(body, "<u8", k, 16)
    start = np.append(np.frombuffer(body, "<i8", k, 16 + 8 * k), n)
    gaps = np.frombuffer(body, "<i4", n, 16 + 16 * k)
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(found, terms), k - 1)
    number = np.flatnonzero(found[at] == terms)
    first, size = start[at[number]], (start[1:] - start[:-1])[at[number]]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    run = np.cumsum(gaps[place], dtype=np.int64)
    before = np.concatenate(([0], run[ends - 1]))[:-1] if len(ends) else ends
    return np.repeat(number, size), run - np.repeat(before, size)


def _starts(lengths: np.ndarray, gap: int) -> np.ndarray:
    """Where each document of a segment begins."""
    return np.concatenate(([0], np.cumsum(lengths + gap)[:-1])).astype(np.int64) if len(lengths) else lengths


def index_segments(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """A row of the index for each run of rows (id, key, text)."""
    for batch in slices(batches, 2, SEGMENT_BYTES):
        found = [words_of(t) for t in batch.column(2).to_pylist()]
        lengths = np.array([len(f) for f in found], np.int64)
        codes = word_codes([w for f in found for w in f])
        at = np.arange(len(codes)) + np.repeat(_starts(lengths, gap) - (np.cumsum(lengths) - lengths), lengths)
        columns = [[batch.column(0).to_pylist()], [batch.column(1).to_pylist()], [lengths], [pack_postings(codes, at)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)


class Segment:
    """Sorted keys (term, position) of one segment; a list is a slice of them."""

    SHIFT = np.int64(1 << 33)

    def __init__(self, terms: np.ndarray, positions: np.ndarray, n_terms: int):
        self.keys = terms * self.SHIFT + positions
        self.positions = positions
        self.bounds = np.searchsorted(self.keys, np.arange(n_terms + 1, dtype=np.int64) * self.SHIFT)
        self.freq = np.diff(self.bounds)

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term's list has a position in [low, high]."""
        at = np.searchsorted(self.keys, term * self.SHIFT + np.maximum(low, 0))
        at = np.minimum(at, max(len(self.keys) - 1, 0))
        key = self.keys[at]
        return (key >= term * self.SHIFT + np.maximum(low, 0)) & (key <= term * self.SHIFT + high)

    def search(self, windows: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matches as (window, start, place of its rarest term), from intersecting each window's lists from the rarest term on."""
        if not len(windows) or not len(self.keys):
            return
        freq = self.freq[windows]
        live = np.flatnonzero(freq.min(axis=1) > 0)
        order = np.argsort(freq[live], axis=1, kind="stable")
        first = windows[live, order[:, 0]]
        count = self.freq[first]
        done = np.cumsum(count)
        i = 0
        while i < len(live):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + CANDIDATES, side="right")))
            n = count[i:j]
            row = np.repeat(np.arange(i, j), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.bounds[first[row]] + inside] - order[row, 0]
            for k in range(1, windows.shape[1]):
                term = windows[live[row], order[row, k]]
                expect = start + order[row, k]
                ok = self.within(term, expect - slop, expect + slop)
                row, start = row[ok], start[ok]
            ok = start >= 0 if not slop else np.ones(len(row), bool)
            yield live[row[ok]], start[ok], start[ok] + order[row[ok], 0]
            i = j


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Disjoint ascending [start, end) spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_segments(
    batches: Iterator[pa.RecordBatch], block: Windows, gap: int, slop: int | None
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, keys, lengths, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
            sizes = np.array(lengths, np.int64)
            starts = _starts(sizes, gap)
            segment = Segment(*unpack_postings(blob, block.terms), len(block.terms))
            spans: dict[int, list] = {}
            items: dict[int, set[int]] = {}
            near: dict[int, set[int]] = {}
            for n, (windows, holders) in block.groups.items():
                for w, at, _ in segment.search(windows, 0):
                    doc = np.searchsorted(starts, at, side="right") - 1
                    for d, s in zip(doc.tolist(), (at - starts[doc]).tolist()):
                        spans.setdefault(d, []).append((s, s + n))
                    pairs = np.unique(doc * np.int64(len(windows)) + w)
                    for p in pairs.tolist():
                        items.setdefault(p // len(windows), set()).update(holders[p % len(windows)])
                if slop is None:
                    continue
                for w, _, at in segment.search(windows, slop):
                    doc = np.searchsorted(starts, at, side="right") - 1
                    for p in np.unique(doc * np.int64(len(windows)) + w).tolist():
                        near.setdefault(p // len(windows), set()).update(holders[p % len(windows)])
            name = lambda s: [block.names[i] for i in sorted(s or ())]
            rows = range(len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([merge_spans(spans.get(d, [])) for d in rows], _MATCH.field(3).type),
                    pa.array([name(items.get(d)) for d in rows], _MATCH.field(4).type),
                    pa.array([name(near.get(d)) for d in rows], _MATCH.field(5).type),
                ],
                schema=_MATCH,
            )


def build_index(docs: DataFrame, gap: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored positional index of docs over all their words."""
    ship(docs.sparkSession)

    def build(batches):
        yield from settled(index_segments(batches, gap))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(build, _INDEX_DDL), "postings")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    slop: int | None = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each document row: key (of its text), n_words, spans of words inside exact matches, items matched exactly, and items with a
    proximity match (every word of a window within ``slop`` of its place; None: not searched)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // block_bytes))
    found = []
    gap = window + 2 * (slop or 0) + 1
    index = build_index(docs, gap, doc_id, text)
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect()
        block = Windows([(r.id, r.text) for r in rows], window)
        held = spark.sparkContext.broadcast(pickle.dumps(block))

        def search(batches, held=held):
            yield from settled(search_segments(batches, pickle.loads(held.value), gap, slop))

        found.append(index.select(*_INDEX.names).mapInArrow(search, _MATCH_DDL))
    if n_blocks == 1:
        return found[0]
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    # One row from each block for every document row; rows of equal id and equal text share their hits.
    return (
        merged.groupBy("doc_id", "key", "n_words")
        .agg(F.count("*").alias("rows"), flat("spans"), flat("items"), flat("near_items"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / n_blocks).cast("int"))))
        .select("doc_id", "key", "n_words", covered("spans").alias("spans"), "items", "near_items")
    )


def covered(spans: str):
    """Disjoint spans from sorted ones."""
    last = lambda acc: F.element_at(acc, -1)
    joins = lambda acc, s: (F.size(acc) > 0) & (s[0] <= F.try_element_at(acc, F.lit(-1))[1])
    return F.aggregate(
        F.col(spans),
        F.array().cast("array<array<bigint>>"),
        lambda acc, s: F.when(
            joins(acc, s),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], s[1]))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and the hash of the matched items' ids."""
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        words.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (words > 0).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs, with all columns, without the rows that hold any benchmark window. The index goes when these are found."""
    with short_lived():
        found = find_contamination(docs, benchmark, window, None, doc_id, text)
        gone = found.where(F.size("items") > 0).select(F.col("doc_id").alias("id"), "key")
        return without(docs, gone, doc_id, text)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]], window: int = 10) -> list[tuple]:
    """The contract's rows by comparing every window with every position."""
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, names = set(), set()
        for item, t in items:
            v = words_of(t)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(None if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit)))
    return out
