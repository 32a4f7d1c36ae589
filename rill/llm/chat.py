"""Chat formatting by minimum-cost role repair.

Legal turns: an optional system turn, then user and assistant in alternation, beginning with the user; a conversation
ends with either. A turn may be kept (0), merged into the open turn of its role (MERGE), relabelled (RELABEL), or
preceded by inserted empty turns (INSERT each); a relabelled turn may also be merged. Dynamic programming over the
automaton's states, from the last turn to the first, finds the least total cost; of equal choices the first of keep,
merge, relabel, insert is taken at the earliest turn. The repaired sequence is rendered with marked roles.

Every conversation, in order of (turn, role, text), comes as ``n_parts`` parts of ``PART_TURNS`` turns, the last of which may be shorter: one
row a part, so a conversation of any length is in rows of bounded size. Rendered parts join without a seam, and costs and
counts add up, to what the repair of the whole conversation gives: the least cost and the same choices among equals.
A conversation of several parts is ranked by a range sort; each part gives its least cost between any two states (a
small matrix); matrices combine from the end to the cost of what follows each part; with that a part tells where it ends
from each state, hence where the next one starts; then each is repaired by itself.

Defined results: an unknown or null role is relabelled; a null text is empty; null turns come last; repeated rows are
turns of their own; rows with a null id are one conversation; "<|" inside a text becomes "< |"; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT)
MERGE, INSERT, RELABEL = 1, 2, 3
PART_TURNS = 4096
FAR = 1 << 40

_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("n_parts", pa.int64())]
    + [(n, pa.int64()) for n in ("turns", "cost", "merged", "relabelled", "inserted")]
    + [("rendered", pa.string())]
)
_DDL = "conv_id bigint, part bigint, n_parts bigint, turns bigint, cost bigint, merged bigint, relabelled bigint, inserted bigint, rendered string"


def paths() -> list[list[tuple[int, ...] | None]]:
    """The fewest empty turns that lead from each state to each other."""
    out: list[list[tuple[int, ...] | None]] = []
    for q in range(4):
        row: list[tuple[int, ...] | None] = [None] * 4
        row[q] = ()
        wave = [q]
        while wave:
            new = []
            for a in wave:
                for b in NEXT[a]:
                    if row[b] is None:
                        row[b] = (*row[a], b)
                        new.append(b)
            wave = new
        out.append(row)
    return out


PATHS = paths()


def options() -> list[list[list[tuple[int, int, tuple[int, ...], bool, bool]]]]:
    """By state and role: (cost, state after, inserted, whether merged, whether relabelled), in order of preference."""
    table = []
    for q in range(4):
        by_role = []
        for r in range(4):
            own = []
            for target in (SYSTEM, USER, ASSISTANT):
                change = target != r
                for via in range(4):
                    empty = PATHS[q][via]
                    if empty is not None and target in NEXT[via]:
                        own.append((INSERT * len(empty) + RELABEL * change, target, empty, False, change))
                if q == target:
                    own.append((MERGE + RELABEL * change, q, (), True, change))
            own.sort(key=lambda o: (o[0], len(o[2]), o[4], o[3], o[1]))
            best = {}
            for o in own:  # of the options to one state the first is never worse
                best.setdefault(o[1], o)
            by_role.append(sorted(best.values(), key=lambda o: (len(o[2]) > 0, o[4], o[3], o[0], o[1])))
        table.append(by_role)
    return table


OPTIONS = options()


def closing() -> list[tuple[int, tuple[int, ...]]]:
    """By state: the cost and the empty turns of a legal end. Nothing at all is legal."""
    out = [(0, ())]
    for q in (SYSTEM, USER, ASSISTANT):
        ways = [PATHS[q][e] for e in ENDS if PATHS[q][e] is not None]
        least = min(ways, key=len)
        out.append((INSERT * len(least), least))
    return out


CLOSING = closing()


@lru_cache(maxsize=50_000)
def plan(roles: tuple[int, ...], start: int, final: tuple[int, ...]) -> tuple[int, tuple]:
    """The least cost from start, with final costs by state, and the option taken at each turn."""
    value, chosen = list(final), []
    for r in reversed(roles):
        new, pick = [], []
        for q in range(4):
            best = min(OPTIONS[q][r], key=lambda o: o[0] + value[o[1]])  # the first of equals
            new.append(min(FAR, best[0] + value[best[1]]))
            pick.append(best)
        value = new
        chosen.append(pick)
    q, taken = start, []
    for pick in reversed(chosen):
        taken.append(pick[q])
        q = pick[q][1]
    return value[start], tuple(taken)


WHOLE = tuple(c for c, _ in CLOSING)


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


def render(conv: int | None, part: int, n_parts: int, roles: list, texts: list, start: int, rest: tuple[int, ...]) -> tuple:
    """The row of a part that starts in a state; rest: the cost of what follows it, by the state in which it ends."""
    cost, taken = (plan if n_parts == 1 else plan.__wrapped__)(tuple(map(role_number, roles)), start, rest)
    out, q, turns, merged, relabelled, inserted = [], start, 0, 0, 0, 0

    def turn(state: int, text: str) -> None:
        out.append(("<|end|>\n" if q != START else "") + f"<|{ROLES[state]}|>\n{text}")

    for (_, after, empty, joins, changed), text in zip(taken, texts):
        text = (text or "").replace("<|", "< |")
        for e in empty:
            turn(e, "")
            q = e
        if joins:
            out.append("\n\n" + text)
        else:
            turn(after, text)
        q = after
        turns += len(empty) + (not joins)
        merged, relabelled, inserted = merged + joins, relabelled + changed, inserted + len(empty)
    if part == n_parts - 1:
        for e in CLOSING[q][1]:
            turn(e, "")
            q = e
            turns, inserted = turns + 1, inserted + 1
        out.append("<|end|>\n" if q != START else "")
    else:
        cost -= rest[q]
    return conv, part, n_parts, turns, cost, merged, relabelled, inserted, "".join(out)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come together by their first ``keys`` columns."""
    key, held = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if row[:keys] != key and held:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row)
    if held:
        yield key, held


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (render(key[0], 0, 1, [r[2] for r in own], [r[3] for r in own], START, WHOLE) for key, own in runs(batches, 1))
    yield from in_batches(rows, _SCHEMA, 200)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def rows():
        for (conv, part), own in runs(batches, 2):
            roles = tuple(role_number(r[3]) for r in own)
            ends = [tuple(0 if q == e else FAR for q in range(4)) for e in range(4)]
            yield conv, part, [plan.__wrapped__(roles, s, e)[0] for s in range(4) for e in ends]

    yield from in_batches(rows(), schema)


def follow(pdf):
    """The cost of what follows each part of one conversation, by the state in which the part ends, from the parts' matrices (pandas
    frames)."""
    import pandas as pd

    pdf = pdf.sort_values("part")
    m = np.array(pdf["costs"].tolist(), np.int64).reshape(-1, 4, 4)
    rest = [np.array(WHOLE, np.int64)]
    for x in m[:0:-1]:
        rest.append(np.minimum((x + rest[-1]).min(axis=1), FAR))
    return pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "n_parts": len(m), "rest": [r.tolist() for r in reversed(rest)]})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def rows():
        for (conv, part), own in runs(batches, 2):
            roles, rest = tuple(role_number(r[3]) for r in own), tuple(own[0][6])
            yield conv, part, [plan.__wrapped__(roles, s, rest)[1][-1][1] for s in range(4)]

    yield from in_batches(rows(), schema)


def chain(pdf):
    """The state in which each part of one conversation starts (pandas frames)."""
    import pandas as pd

    pdf = pdf.sort_values("part")
    starts, q = [], START
    for ends in pdf["ends"]:
        starts.append(q)
        q = int(ends[q])
    return pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "start": starts})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv, part), own in runs(batches, 2):
            n_parts, rest, start = own[0][5:8]
            yield render(conv, part, n_parts, [r[3] for r in own], [r[4] for r in own], start, tuple(rest))

    yield from in_batches(rows(), _SCHEMA, 20)


def in_blocks(turns: DataFrame, block: int) -> DataFrame:
    """Rows of long conversations by the block of their rank: a range sort, numbered within its partitions and offset by
    the counts of earlier ones."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    parts = max(8, turns.sparkSession.sparkContext.defaultParallelism)
    ordered = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")
    ordered = ordered.withColumn("run", F.shiftright("at", 33))
    counts = ordered.groupBy("conv_id", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    # A row for each conversation and partition: no more than conversations and partitions together.
    found = ordered.alias("o").join(
        counts.alias("c"), F.col("o.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("o.run") == F.col("c.run"))
    )
    rank = F.col("c.before") + F.col("o.at") - F.col("c.first")
    return found.select(
        "o.conv_id", F.floor(rank / block).cast("long").alias("part"), rank.alias("rank"), "o.role", "o.text"
    )


def format_chats(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """conv_id, part, n_parts, turns, cost, merged, relabelled, inserted and rendered of every part of every conversation."""
    ship(turns.sparkSession)
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    long = stored(rows.groupBy("conv_id").count().where(F.col("count") > part_turns).select(F.col("conv_id").alias("long_id")), "long")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    short = rows.join(long, is_long, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    out = short.mapInArrow(_whole, _DDL)
    if not long.limit(1).count():
        return out
    blocks = stored(in_blocks(rows.join(long, is_long, "left_semi"), part_turns), "blocks")
    of_part = "conv_id bigint, part bigint"

    def dealt(parts: DataFrame) -> DataFrame:
        return parts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "rank")

    def known(parts: DataFrame, more: DataFrame) -> DataFrame:
        same = F.col("b.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("b.part") == F.col("s.part"))
        return parts.alias("b").join(more.alias("s"), same).select("b.*", *[F.col(f"s.{n}") for n in more.columns[2:]])

    # One row of a few numbers for each part of a conversation.
    matrices = dealt(blocks).mapInArrow(_matrices, f"{of_part}, costs array<bigint>")
    rest = stored(matrices.groupBy("conv_id").applyInPandas(follow, f"{of_part}, n_parts bigint, rest array<bigint>"), "rest")
    ends = dealt(known(blocks, rest)).mapInArrow(_ends, f"{of_part}, ends array<int>")
    starts = stored(ends.groupBy("conv_id").applyInPandas(chain, f"{of_part}, start int"), "starts")
    return out.unionByName(dealt(known(known(blocks, rest), starts)).mapInArrow(_parts, _DDL))
