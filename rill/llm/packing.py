"""Best-fit packing by minimum bin slack.

1. Every text becomes its token ids and an end id; only a sequence longer than ``limit`` is cut into pieces of
   ``limit`` tokens. Pieces (without their ids) are a stored table.
2. The number of pieces of each length, at most ``limit`` counts whatever the input, is all that planning needs. The
   plan fills one bin after the other: the longest piece left opens it, and a bitset subset-sum dynamic program over the
   available lengths finds the fullest feasible completion. The combination is removed as often as the counts allow,
   so there are at most as many steps as lengths run out.
3. Each piece has a gapless rank among the pieces of its length, found without gathering a length in one task; length
   and rank give its bin and its place there by a lookup in the plan.

Defined results: a null text packs as an empty one (the end id alone); repeated rows are packed each for itself; an
empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, settled, ship, slices, stored
from .tokens import CACHED, word_encoder

LIMIT = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are encoded together.
CALL_BYTES = 6_000_000

_PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id",)]
    + [("piece", pa.int32())]
    + [(n, pa.int64()) for n in ("start", "length", "ids_crc32")]
)
_PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_batches(
    batches: Iterator[pa.RecordBatch],
    vocabulary: str,
    limit: int,
    end_id: int,
    call_bytes: int = CALL_BYTES,
    cached: int = CACHED,
) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(vocabulary, cached)
    end = np.array([end_id], "<u4").tobytes()
    for batch in slices(batches, 1, call_bytes):
        ids, counts = encoder.encode_array(pc.fill_null(batch.column(1), ""))
        rows: list[tuple] = []
        for doc, n, z in zip(batch.column(0).to_pylist(), counts.tolist(), np.cumsum(counts).tolist()):
            body = ids[z - n : z]
            for k, at in enumerate(range(0, n + 1, limit)):
                crc, size = zlib.crc32(body[at : at + limit]), min(n + 1 - at, limit)
                if at + size > n:
                    crc = zlib.crc32(end, crc)
                rows.append((doc, k, at, size, crc))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, how many) whose sum is the largest up to room; available: (length, count), longest first.

    A bitset holds the sums that can be reached; counts go in as powers of two, so a length costs a few shifts.
    """
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, count in available:
        if length > room:
            continue
        left, k = min(count, room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, sums))
            sums |= (sums << (length * k)) & mask
            left -= k
            k *= 2
        if sums >> room:
            break
    total, used = sums.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, the lengths in each with how many) until every piece has a place."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        first = max(left)
        rest = sorted(((n, c - (n == first)) for n, c in left.items()), reverse=True)
        chosen = dict(fullest([(n, c) for n, c in rest if c], limit - first))
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        plan.append((times, sorted(chosen.items(), reverse=True)))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def plan_table(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, how many in a bin, offset in the bin), by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    bins = 0
    for times, chosen in plan:
        at = 0
        for n, k in chosen:
            rank = ranks.get(n, 0)
            rows.setdefault(n, []).append((rank, bins, k, at))
            ranks[n] = rank + k * times
            at += n * k
        bins += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def _place(lengths: np.ndarray, ranks: np.ndarray, plan: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        t = plan[int(n)]
        row = t[np.searchsorted(t[:, 0], ranks[at], side="right") - 1]
        inside = ranks[at] - row[:, 0]
        sequence[at] = row[:, 1] + inside // row[:, 2]
        offset[at] = row[:, 3] + inside % row[:, 2] * n
    return sequence, offset


def token_pieces(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    call_bytes: int = CALL_BYTES,
    cached: int = CACHED,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. A worker's memory goes with the bytes of text that are
    encoded together and the chunks kept; smaller ones cost time."""
    ship(docs.sparkSession)

    def run(batches):
        yield from settled(cut_batches(batches, vocabulary, limit, end_id, call_bytes, cached))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _PIECES_DDL)


def pack_pieces(pieces: DataFrame, limit: int = LIMIT, columns: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` in 1..limit. pieces is read three times: store it before.

    ``columns`` order the pieces of one length; rows that are equal in them may swap places.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    held = spark.sparkContext.broadcast(pickle.dumps(plan_table(plan_bins(counts, limit))))
    numbered = ranked(pieces, ["length"], [*columns, "ids_crc32"], "rank", sum(counts.values()))
    kept = [c for c in pieces.columns]

    def run(batches):
        plan = pickle.loads(held.value)
        for b in batches:
            sequence, offset = _place(b.column("length").to_numpy(), b.column("rank").to_numpy(), plan)
            out = [b.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{ddl}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end_id: int = END_ID, **memory: int) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; memory: as of token_pieces."""
    return pack_pieces(stored(token_pieces(docs, vocabulary, limit, end_id, **memory), "pieces"), limit)
