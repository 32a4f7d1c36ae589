"""K-d tree sharding with DataFrame functions only.

The unit of placement is a group of equal texts with the smallest metadata of its rows. Law ``bytes``: shard sizes
near equal.

1. Rows are reduced to id, size, checksum, text key and quantised metadata coordinates (a stored table), and grouped by
   text key with partial sums; a group of any size is one row.
2. Groups heavier than 1/50 of a shard (by bytes or rows; at most 100 a shard exist) are placed one by one, the heaviest
   first, each whole in the emptiest shard. Only a group that no shard can hold is split, into the fewest equal parts.
   These go round the tree, whose leaves could not stay near equal with them: all groups of a table of fewer than HEAVY rows a
   shard, none of a large table without big groups. Leaves stop at the number of shards: their target bytes are the total by it.
3. What room is left makes the leaves' targets. Level by level, every node is split along its widest dimension at the
   distributed weighted quantile that its halves' targets ask for (the median when they are equal): one grouped sum over
   the dimension's values, and within the value on the boundary one over a hash, so that ties split finely. The driver
   holds the tree, never more rows than nodes.
4. The tree compiles to one CASE expression. Slots are gapless ranks found without gathering a shard in one task.

Defined results: a null text has size 8, no checksum, and its rows are one group; null metadata have coordinate 0; every
row of a repeated document gets its own slot; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ranked, stored

HEAVY = 50
CELLS = 65536


@dataclass
class Node:
    """Shards [first, last); a split sends a unit left if (coordinate, cell) < (value, cell)."""

    first: int
    last: int
    dim: int = -1
    value: int = 0
    cell: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def place(self, dims: list[str], at) -> Column:
        """The expression that gives ``at(leaf)`` for a unit."""
        if self.left is None:
            return F.lit(at(self))
        x = F.col(dims[self.dim])
        goes_left = (x < self.value) | ((x == self.value) & (F.col("cell") < self.cell))
        return F.when(goes_left, self.left.place(dims, at)).otherwise(self.right.place(dims, at))


def coordinates(docs: DataFrame, dims: tuple[str, ...], size: Column) -> list[Column]:
    """Whole numbers from 0 to CELLS - 1: the logarithm of the size, and a code for each metadata value."""
    own = [F.least(F.lit(CELLS - 1), (F.log2(size.cast("double")) * 1024).cast("int"))]
    for name in dims:
        code = F.shiftrightunsigned(F.crc32(F.col(f"`{name}`").cast("string").cast("binary")), 16).cast("int")
        own.append(F.coalesce(code, F.lit(0)))
    return own


def place_heavy(groups: list[tuple[int, int, int]], target: float, shards: int) -> tuple[list, list[float]]:
    """(key, shard of each part) and the bytes placed in each shard; groups: (key, rows, size of a row)."""
    load, placed = [0.0] * shards, []
    for share in (1.0, 0.5, 0.25, 0.1, 0.04, 0.02, 0.01):
        placed, heap = [], [(0.0, s) for s in range(shards)]
        parts = []
        for key, n, size in groups:
            k = min(n, max(1, -int(-(n * size) // (share * target))))
            parts += [(-size * ((n - i + k - 1) // k), key, i, k) for i in range(k)]
        homes: dict[int, list[int]] = {}
        for weight, key, i, k in sorted(parts):
            w, s = heapq.heappop(heap)
            heapq.heappush(heap, (w - weight, s))
            homes.setdefault(key, [0] * k)[i] = s
        for w, s in heap:
            load[s] = w
        placed = list(homes.items())
        if max(load) <= target * 1.001:
            break
    return placed, load


def split_level(units: DataFrame, nodes: list[Node], tree: Node, dims: list[str], room: list[float], spread: list) -> None:
    """Splits every node of a level at its weighted quantile."""
    number = {id(n): i for i, n in enumerate(nodes)}
    at = units.withColumn("node", tree.place(dims, lambda leaf: number.get(id(leaf), -1))).where("node >= 0")
    ends = at.groupBy("node").agg(
        F.sum("weight").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    )
    seen = {r["node"]: r for r in ends.collect()}
    goal, chosen = {}, {}
    for i, n in enumerate(nodes):
        mid = (n.first + n.last) // 2
        n.left, n.right = Node(n.first, mid), Node(mid, n.last)
        r = seen.get(i)
        if r is None:
            n.dim, n.value = 0, 0
            continue
        width = [(r[f"max_{d}"] - r[f"min_{d}"]) / s for d, s in zip(dims, spread)]
        n.dim = chosen[i] = max(range(len(dims)), key=lambda k: width[k])
        here = sum(room[n.first : n.last])
        goal[i] = float(r["w"]) * (sum(room[n.first : mid]) / here if here > 0 else (mid - n.first) / (n.last - n.first))
    if not goal:
        return
    pick = lambda m, kind: reduce(lambda c, kv: c.when(F.col("node") == kv[0], kv[1]), m.items(), F).otherwise(None).cast(kind)
    coord = pick({i: F.col(dims[d]) for i, d in chosen.items()}, "int")
    on_dim = crossing(at.withColumn("x", coord), "x", pick({i: F.lit(g) for i, g in goal.items()}, "double"))
    for r in on_dim.collect():
        nodes[r["node"]].value = r["x"]
        goal[r["node"]] -= r["before"]
    tie = pick({i: F.lit(nodes[i].value) for i in goal}, "int")
    ties = at.withColumn("x", coord).where(F.col("x") == tie)
    for r in crossing(ties, "cell", pick({i: F.lit(g) for i, g in goal.items()}, "double")).collect():
        over = r["before"] + r["w"] - goal[r["node"]]
        nodes[r["node"]].cell = r["cell"] + (1 if over < goal[r["node"]] - r["before"] else 0)


def crossing(at: DataFrame, by: str, goal: Column) -> DataFrame:
    """For each node, the first value whose running weight reaches the goal, and the weight before it.

    At most CELLS sums of each node are sorted, whatever the input."""
    sums = at.groupBy("node", by).agg(F.sum("weight").cast("double").alias("w"))
    run = F.sum("w").over(W.partitionBy("node").orderBy(by))
    reached = sums.withColumn("run", run).withColumn("goal", goal).where((F.col("run") >= F.col("goal")) | (F.lit(0) > F.col("goal")))
    first = F.row_number().over(W.partitionBy("node").orderBy(by))
    return reached.withColumn("k", first).where("k = 1").select("node", by, "w", (F.col("run") - F.col("w")).alias("before"))


def kd_shards(
    docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source"), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    names = ["d0", *(f"d{i + 1}" for i in range(len(dims)))]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text), size, F.col(text).isNull()).alias("key"),
        *[c.alias(n) for n, c in zip(names, coordinates(docs, dims, size))],
    )
    rows = stored(rows, "rows")
    units = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("size").alias("size"), *[F.min(n).alias(n) for n in names]
    )
    units = units.withColumn("weight", F.col("n") * F.col("size"))
    units = units.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(CELLS)).cast("int"))
    units = stored(units, "units")
    all_ = units.agg(F.sum("weight").alias("w"), F.sum("n").alias("n"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    total, count = int(all_["w"] or 0), int(all_["n"] or 0)
    target = total / shards
    is_heavy = (F.col("weight") > target / HEAVY) | (F.col("n") > count / shards / HEAVY)
    if not count:
        is_heavy = F.lit(False)
    heavy = [(r.key, r.n, r.size) for r in units.where(is_heavy).select("key", "n", "size").collect()]  # 2 * HEAVY * shards at most
    homes, load = place_heavy(heavy, target, shards)
    room = [max(0.0, target - x) for x in load]
    light = units.where(~is_heavy)
    tree = Node(0, shards)
    spread = [max(1, int(all_[n] or 0)) for n in names]
    while level := [n for n in tree.leaves() if n.last - n.first > 1]:
        split_level(light, level, tree, names, room, spread)
    where = json.dumps([{"key": str(k), "homes": h} for k, h in homes])
    known = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(where), "array<struct<key:string,homes:array<int>>>")))
    known = known.select(F.col("key").cast("long").alias("key"), "homes")
    kept = ["doc_id", "size", "text_crc32", "key"]
    # known has a row for each heavy group, 2 * HEAVY * shards at most: small whatever the input.
    apart = rows.select(*kept).join(F.broadcast(known), "key")
    whole = apart.where(F.size("homes") == 1).select(*kept, F.col("homes")[0].alias("shard"))
    divided = ranked(apart.where(F.size("homes") > 1), ["key"], ["doc_id"], "at", count)
    divided = divided.select(*kept, F.element_at("homes", (F.pmod("at", F.size("homes")) + 1).cast("int")).alias("shard"))
    placed = light.select("key", tree.place(names, lambda leaf: leaf.first).alias("shard"))
    rest = rows.select(*kept).join(F.broadcast(known.select("key")), "key", "left_anti").join(placed, "key")
    parts = [rest.select(*kept, "shard"), whole]
    if any(len(h) > 1 for _, h in homes):
        parts.append(divided)
    out = stored(reduce(DataFrame.unionByName, parts), "placed")
    return ranked(out, ["shard"], ["doc_id", "key"], "slot", count).select("doc_id", "size", "text_crc32", "shard", "slot")
