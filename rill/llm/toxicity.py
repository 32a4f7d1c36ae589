"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on ordinary and one on toxic text. Both begin with what the trainer makes of
windows of ordinary text, so that ordinary windows compress alike; the toxic one ends with what the trainer makes of toxic
text less what is common in ordinary text (only words stay that hold a run of ``RUN`` bytes which at least ``LEAST_RATIO``
times the share of toxic texts have), and the ordinary one with as many bytes that match nothing.

A text is its words (see ``common``), each after a mark of two bytes, so that a match of six bytes tells where words begin.
Windows of ``WINDOW`` words overlap by half, cover the whole text, and end in a tail, as the last bytes of a block are
never matched. Every window is compressed with both dictionaries, once for each of two least match lengths; the
difference of the two lengths is its gain. How many of a text's windows, and what share of them, reach each gain from 1 to 8 is
calibrated to a probability by logistic regression, on texts that the dictionary at hand was not trained on: the sample
is cut in ``FOLDS`` parts, and each is measured with a dictionary of the others. The final one is trained on all.

Defined results: null, empty and wordless texts are one window without words; very long texts have as many windows as it
takes; without examples of either label all scores are the share of toxic examples (one half without any); repeated labels of a
document are averaged, null ones and those of null ids left out; repeated documents get a row and the same score each, and count
once in training; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, ship, slices, words_of

#: Bounds of the sample of labelled rows: about so many are read, and about so many bytes of their texts.
TOXIC_ROWS = 2500
ORDINARY_ROWS = 4500
SAMPLE_BYTES = 32_000_000
FOLDS = 3
#: Words of a window, and from one window to the next.
WINDOW, STEP = 6, 3
MARK, TAIL = b"  ", b"\n" * 9
LEAST_MATCHES = 5, 6
GAINS = range(1, 9)
#: Trained bytes of ordinary text, and of either class's own end (with the entropy tables in front of the latter).
BASE_BYTES, OWN_BYTES, TABLE_BYTES = 64 * 1024, 2048, 256
#: Runs of bytes that set toxic words apart: length, texts that have one, how much oftener than ordinary texts.
RUN, LEAST_COUNT, LEAST_RATIO = 7, 8, 8
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CALL_BYTES = 1_000_000


def windows_of(words: list[bytes]) -> list[bytes]:
    """The windows of a text, one at least."""
    starts = range(0, max(1, len(words) - WINDOW + STEP), STEP)
    return [MARK + MARK.join(words[i : i + WINDOW]) + MARK + TAIL for i in starts]


def trained(size: int, samples: list[bytes], segment: int, run: int) -> bytes:
    """A dictionary's content by the library's trainer, or the samples themselves where they are too few to train on."""
    try:
        return Z.train_dictionary(size, samples, k=segment, d=run).as_bytes()[TABLE_BYTES:]
    except Z.ZstdError:
        return b"".join(samples)[: size - TABLE_BYTES]


def runs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, run) of each run of RUN bytes in a word between marks; runs are numbers."""
    chunks = [MARK + w + MARK for w in words]
    owner = np.repeat(np.arange(len(chunks)), [len(x) for x in chunks])
    b = np.frombuffer(b"".join(chunks), np.uint8).astype(np.int64)
    n = max(0, len(b) - RUN + 1)
    run = np.zeros(n, np.int64)
    for j in range(RUN):
        run = (run << 8) | b[j : n + j]
    inside = owner[:n] == owner[len(owner) - n :]
    return owner[:n][inside], run[inside]


def distinctive(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words of toxic texts that hold a run which far more of them have than ordinary texts."""
    own, other = (Counter(w for t in texts for w in set(t)) for texts in (toxic, ordinary))
    words = list(own)
    if not words or not ordinary:
        return set(words)
    at, run = runs_of(words)
    known, place = np.unique(run, return_inverse=True)
    here = np.bincount(place, np.array([own[w] for w in words])[at], len(known))
    there = np.zeros(len(known))
    rest = list(other)
    for i in range(0, len(rest), 100_000):
        part = rest[i : i + 100_000]
        a, r = runs_of(part)
        k = np.minimum(np.searchsorted(known, r), max(len(known) - 1, 0))
        same = known[k] == r if len(known) else np.zeros(0, bool)
        there += np.bincount(k[same], np.array([other[w] for w in part])[a[same]], len(known))
    apart = (here >= LEAST_COUNT) & (here / len(toxic) >= LEAST_RATIO * (there + 0.5) / len(ordinary))
    return {words[i] for i in np.unique(at[apart[place]])}


def base_of(ordinary: list[list[bytes]]) -> bytes:
    """What the trainer makes of windows of ordinary text."""
    windows = [w[: -len(TAIL)] for t in ordinary for w in windows_of(t)[::2]]
    random.Random(11).shuffle(windows)
    return trained(BASE_BYTES, [w for w in windows[:40_000] if len(w) >= 8], 32, 8)


def toxic_end(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> bytes:
    """What the trainer makes of toxic text less what ordinary text has as well."""
    kept = distinctive(toxic, ordinary)
    samples = [b"".join(MARK + w for w in t if w in kept) + MARK for t in toxic]
    return trained(OWN_BYTES, [x for x in samples if len(x) >= 8], 16, RUN)


class Dictionaries:
    """The content of the ordinary and the toxic dictionary."""

    def __init__(self, base: bytes, end: bytes):
        self.ordinary, self.toxic = base + bytes(len(end)), base + end

    def compressors(self) -> list[tuple[Z.ZstdCompressor, Z.ZstdCompressor]]:
        """(ordinary, toxic) for each least match length."""

        def make(content: bytes, least: int) -> Z.ZstdCompressor:
            params = Z.ZstdCompressionParameters.from_level(
                3, source_size=WINDOW * 12, dict_size=max(1, len(content)), strategy=Z.STRATEGY_GREEDY, min_match=least, search_log=4,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            return Z.ZstdCompressor(dict_data=Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT), compression_params=params)

        return [(make(self.ordinary, n), make(self.toxic, n)) for n in LEAST_MATCHES]


def lengths(compressor: Z.ZstdCompressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(Z.BufferWithSegments(data, segments.astype("<u8").tobytes()), threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def gains(windows: list[bytes], compressors: list) -> list[np.ndarray]:
    """By least match length: how much shorter each window gets with the toxic dictionary."""
    sizes = np.array([len(w) for w in windows], np.int64)
    segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)
    data = b"".join(windows)
    return [lengths(ordinary, data, segments) - lengths(toxic, data, segments) for ordinary, toxic in compressors]


def features(texts: list[str | None], compressors: list) -> np.ndarray:
    """A row for each text: what its windows gain."""
    parts = [windows_of(words_of(t)) for t in texts]
    count = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(count) - count
    columns = [np.log(count)]
    for x in gains([w for p in parts for w in p], compressors):
        columns += [np.maximum.reduceat(x, first), np.add.reduceat(x, first) / count]
        for reached in [x >= k for k in GAINS] + [x <= -1]:
            n = np.add.reduceat(reached.astype(np.int64), first)
            columns += [np.log1p(n), n / count]
    return np.column_stack(columns)


class Logistic:
    """Weighted logistic regression with a small ridge, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._design(x)
        self.w = np.zeros(a.shape[1])
        penalty = ridge * weight.sum() * np.r_[np.ones(a.shape[1] - 1), 1e-6]
        for _ in range(50):
            p = self._sigmoid(a @ self.w)
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
            step = np.linalg.solve(h, a.T @ (weight * (p - y)) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(x) @ self.w)


class Model:
    def __init__(self, texts: list[str], labels: list[int], share: float | None = None):
        """share: of toxic rows among all labelled ones, where the sample has another."""
        y = np.array(labels, np.int64)
        self.constant = (float(y.mean()) if len(y) else 0.5) if len(y) < 2 or len(set(labels)) < 2 else None
        if self.constant is not None:
            return
        own: dict[int, list[str]] = {label: sorted({t for t, k in zip(texts, labels) if k == label}) for label in (0, 1)}
        for kept in own.values():
            random.Random(5).shuffle(kept)
        words = {label: [words_of(t) for t in kept] for label, kept in own.items()}
        x, yy = [], []
        for fold in range(FOLDS):
            others = {k: [t for i, t in enumerate(w) if i % FOLDS != fold] or w for k, w in words.items()}
            c = Dictionaries(base_of(others[0]), toxic_end(others[1], others[0])).compressors()
            rows = [(k, t) for k, kept in own.items() for t in kept[fold::FOLDS]]
            for a in range(0, len(rows), 100):
                x.append(features([t for _, t in rows[a : a + 100]], c))
            yy += [k for k, _ in rows]
        known = np.array(yy)
        share = y.mean() if share is None else share
        weight = np.where(known == 1, share / known.mean(), (1 - share) / (1 - known.mean()))
        self.calibrated = Logistic(np.vstack(x), known, weight)
        self.dictionaries = Dictionaries(base_of(words[0]), toxic_end(words[1], words[0]))

    def scores(self, texts: list[str | None], compressors: list) -> np.ndarray:
        return self.calibrated(features(texts, compressors))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], doc_id: str = "doc_id", text: str = "text"
) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample of each label's rows, and the share of label 1 among all labelled rows. Texts of
    more than a hundredth of SAMPLE_BYTES are not learned from."""
    one = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], [], 0.5
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) / 1e6
    kept = F.lit(False)
    for y, n in counts.items():
        kept = kept | ((F.col("y") == y) & (draw < most[y] / n))
    picked = one.where(kept).limit(2 * sum(most.values()))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # picked has 2 * sum(most) rows at most, of two numbers each.
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    known = own.where(size <= SAMPLE_BYTES // 100).join(F.broadcast(picked), "id").select("id", "text", "y")
    total_bytes = known.agg(F.sum(size)).first()[0] or 0
    if total_bytes > SAMPLE_BYTES:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(19)), F.lit(1_000_000)) / 1e6 < SAMPLE_BYTES / total_bytes)
    rows = known.limit(4 * sum(most.values())).toArrow()
    rows = sorted(zip(rows["id"].to_pylist(), rows["text"].to_pylist(), rows["y"].to_pylist()), key=lambda r: (r[0], r[1] or ""))
    return [r[1] or "" for r in rows], [r[2] for r in rows], counts.get(1, 0) / total


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and score of every row of docs; labels (doc_id, label) are all that is learned from."""
    spark = docs.sparkSession
    ship(spark)
    texts, y, share = labelled_sample(docs, labels, label, {0: ORDINARY_ROWS, 1: TOXIC_ROWS}, doc_id, text)
    held = spark.sparkContext.broadcast(pickle.dumps(Model(texts, y, share)))

    def run(batches: Iterator[pa.RecordBatch]):
        model = pickle.loads(held.value)
        compressors = model.dictionaries.compressors() if model.constant is None else []
        for b in slices(batches, 1, CALL_BYTES):
            if model.constant is None:
                score = model.scores(b.column(1).to_pylist(), compressors)
            else:
                score = np.full(len(b), model.constant)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: settled(run(batches)), "doc_id bigint, score double")
