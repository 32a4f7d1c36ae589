"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: each vector, less a centre fitted on a bounded sample, is scaled to length 1, rotated by a random orthogonal
matrix and kept as its signs in packed bits, with its length, the inner product of code and rotated vector (the
correction scalar) and its inner product with the centre. Every row is indexed.

Search: queries go in blocks of at most ``BLOCK`` against all rows. A rotated query is rounded to ``PLANES`` bits a component, so its
inner product with a code is a weighted sum of population counts of packed words, one for each bit plane. With the
correction scalars that estimates the inner product; its error is below
length * |query| * sqrt((1 - f * f) / (f * f)) * EPSILON / sqrt(dimensions - 1) but for chance, plus what rounding the query can
change at most. Only rows whose upper bound reaches the query's k-th best so far (at first: the k-th best lower bound) are
reranked with the original vectors, in double precision and in the order of components, so equal vectors tie exactly. Vectors of
other rows are not touched.

Defined results: vectors that are null, zero, hold null or non-finite components, or have not the commonest dimension
take no part, nor rows with a null id; every row of a repeated id is a candidate, the first (by its bytes) is the query;
a query's own id is no candidate; empty tables give empty tables.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, ship, stored

#: Rows that the centre is fitted on, about.
SAMPLE = 10_000
BLOCK = 16384
#: Bits of a component of a rotated query.
PLANES = 6
EPSILON = 3.5
SEED = 20_240_601
#: Queries whose estimates are held at a time.
GROUP = 128

_INDEX_DDL = "vec_id bigint, vec binary, code binary, length double, f double, centre double"
_FOUND_DDL = "query_id bigint, vec_id bigint, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    ok = sizes == dim
    picked = column.filter(pa.array(ok))
    flat = picked.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good]


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, correction scalars and inner products with the centre."""
    rest = x - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = rest / np.where(length > 0, length, 1)[:, None]
    y = unit @ turn
    f = np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(y >= 0, axis=1), length, np.where(length > 0, f, 1.0), x @ centre


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of components, the same wherever a row stands."""
    return np.cumsum(x * q, axis=1)[:, -1]


def packed_words(code: np.ndarray) -> np.ndarray:
    """Rows of packed bits as 64-bit words."""
    out = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    out[:, : code.shape[1]] = code
    return out.view(np.uint64)


class Search:
    """The best k of the rows seen so far for a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float):
        self.ids, self.q, self.k = ids, queries, k
        dim = queries.shape[1]
        turned = queries @ turn / np.sqrt(dim)
        low = turned.min(axis=1, initial=0)
        step = np.maximum((turned.max(axis=1, initial=0) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        self.planes = [packed_words(np.packbits(level >> j & 1, axis=1)) for j in range(PLANES)]
        rounded = low[:, None] + step[:, None] * level
        # <signs, rounded> = 2 * (low * ones + step * counts) - the sum of rounded
        self.low, self.step, self.all = (x.astype(np.float32) for x in (2 * low, 2 * step, rounded.sum(axis=1)))
        rounding = np.sqrt(((turned - rounded) ** 2).sum(axis=1) * dim)
        self.norm = np.sqrt((queries * queries).sum(axis=1)).astype(np.float32)
        self.rounding = rounding.astype(np.float32)
        self.at_centre = (queries @ centre).astype(np.float32)
        self.scale = epsilon / np.sqrt(max(dim - 1, 1))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]

    def counted(self, words: np.ndarray, rows: slice) -> np.ndarray:
        """The inner products of the codes with the rounded levels of some queries, by population counts."""
        out = np.zeros((len(self.ids[rows]), len(words)), np.uint32)
        for j, plane in enumerate(self.planes):
            for w in range(words.shape[1]):
                out += np.bitwise_count(plane[rows, w, None] & words[None, :, w]).astype(np.uint32) << j
        return out

    def add(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, length, f, at_centre) -> None:
        words = packed_words(code)
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.float32)
        factor = (length / f).astype(np.float32)
        slack = (length * np.sqrt(np.maximum(1 - f * f, 0)) / f * self.scale).astype(np.float32)
        margin = np.float32(1e-5) * (1 + length.astype(np.float32) + np.abs(at_centre).astype(np.float32))
        for i in range(0, len(self.ids), GROUP):
            rows = slice(i, i + GROUP)
            signs = self.step[rows, None] * self.counted(words, rows) + self.low[rows, None] * ones - self.all[rows, None]
            est = signs * factor + self.at_centre[rows, None]
            err = self.norm[rows, None] * (slack + margin) + self.rounding[rows, None] * factor
            for j in range(len(est)):
                self._rerank(i + j, est[j], err[j], ids, x)

    def _rerank(self, i: int, est: np.ndarray, err: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        score, own = self.best[i]
        floor = score[-1] if len(score) == self.k else -np.inf
        if not np.isfinite(floor) and len(est) > self.k + 1:
            lower = est - err
            lower[ids == self.ids[i]] = -np.inf
            floor = np.partition(lower, -self.k)[-self.k]
        at = np.flatnonzero(est + err >= floor)
        at = at[ids[at] != self.ids[i]]
        if len(at) > 4 * self.k:  # by products in another order of sums first, with their rounding as margin
            rough = x[at] @ self.q[i]
            best = max(floor, np.partition(rough, -self.k)[-self.k])
            at = at[rough >= best - 1e-9 * float(self.norm[i]) * max(1.0, float(np.abs(x[at]).max()) * x.shape[1])]
        if not len(at):
            return
        s = inner(x[at], self.q[i])
        score, own = np.append(score, s), np.append(own, ids[at])
        order = np.lexsort((own, -score))[: self.k]
        self.best[i] = score[order], own[order]

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, n), pa.int64()),
                pa.array(np.concatenate([o for _, o in self.best]) if n else [], pa.int64()),
                pa.array(np.concatenate([s for s, _ in self.best]) if n else [], pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int, np.ndarray]:
    """The stored index of every row that takes part, the dimension and the centre."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null")
    kinds = rows.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count()
    top = kinds.where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    dim, count = (top["d"], top["count"]) if top else (1, 0)
    step = max(1, count // SAMPLE)
    taken = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(2 * SAMPLE).toArrow().combine_chunks()
    sample = valid_vectors(taken.column("embedding"), dim)[1] if len(taken) else np.empty((0, dim))
    centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)

    def run(batches: Iterator[pa.RecordBatch]):
        turn = rotation(dim)
        for b in batches:
            ok, x = valid_vectors(b.column(1), dim)
            code, length, f, at = encode(x, centre, turn)
            own = b.column(0).filter(pa.array(ok))
            cells = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (x.astype("<f8"), code)]
            out = [own, *cells, pa.array(length, pa.float64()), pa.array(f, pa.float64()), pa.array(at, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "vec", "code", "length", "f", "centre"])

    cores = spark.sparkContext.defaultParallelism
    chunks = max(min(cores, -(-count // 2000)), -(-count // 500_000), 1)
    return stored(rows.repartition(chunks, F.xxhash64("vec_id")).mapInArrow(run, _INDEX_DDL), "codes"), dim, centre


def nearest(
    vectors: DataFrame, queries: str, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", epsilon: float = EPSILON
) -> DataFrame:
    """The k rows of the largest inner product for each row for which the SQL predicate ``queries`` over vec_id holds."""
    spark = vectors.sparkSession
    index, dim, centre = build_index(vectors, vec_id, embedding)
    asked = index.where(queries).select("vec_id", "vec")
    n_blocks = max(1, -(-asked.count() * 5 // (BLOCK * 4)))
    if n_blocks > 1:  # each block is a folder of its own, and so is read alone
        at = new_path(spark, "asked")
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).write.partitionBy("block").parquet(at)
        asked = spark.read.parquet(at)
    found_at = new_path(spark, "nearest")
    for b in range(n_blocks):
        own = (asked.where(F.col("block") == b) if n_blocks > 1 else asked).select("vec_id", "vec").collect()
        one = {}
        for r in sorted(own, key=lambda r: (r.vec_id, bytes(r.vec))):
            one.setdefault(r.vec_id, bytes(r.vec))
        if not one and b:
            continue
        ids = np.array(list(one), np.int64)
        q = np.frombuffer(b"".join(one.values()), "<f8").reshape(-1, dim)
        held = spark.sparkContext.broadcast(pickle.dumps((ids, q)))

        def run(batches: Iterator[pa.RecordBatch], held=held):
            s = Search(*pickle.loads(held.value), centre, rotation(dim), k, epsilon)
            for batch in batches:
                if not len(batch):
                    continue
                ids, vec, code, length, f, at = (batch.column(i) for i in range(6))
                x = np.frombuffer(b"".join(vec.to_pylist()), "<f8").reshape(-1, dim)
                c = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(x), -1)
                s.add(ids.to_numpy(), x, c, length.to_numpy(), f.to_numpy(), at.to_numpy())
            yield s.rows()

        found = index.mapInArrow(run, _FOUND_DDL)
        if n_blocks > 1:
            found.write.mode("append").parquet(found_at)
            held.destroy()
    if n_blocks > 1:
        found = spark.read.schema(found.schema).parquet(found_at)
    # Each task has at most k rows of a query, so a query's rows are k times the tasks.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
