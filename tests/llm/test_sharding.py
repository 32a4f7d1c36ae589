import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rill.llm import sharding as S


def checked(df, docs, shards):
    got = S.kd_shards(df, shards).collect()
    want = Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return got, load


def test_sizes_near_equal_and_copies_together(spark):
    rnd = random.Random(1)
    docs = [(i, f"{i} " + "x" * int(rnd.lognormvariate(5, 1))) for i in range(4000)]
    docs += [(5000 + i, "same " * 30) for i in range(60)] + [(6000 + i, None) for i in range(40)] + [(7000, ""), (7001, ""), (3, "again")]
    rows = [(i, t, rnd.choice(["en", "fr", None]), f"s{rnd.randrange(9)}", 5) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got, load = checked(df, docs, 24)
    assert max(load) / min(load) < 1.1
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = [(i, "copy of a text") for i in range(600)] + [(1000 + i, f"text {i} " + "y" * (i % 7)) for i in range(900)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string")
    _, load = checked(df, docs, 8)
    assert max(load) / min(load) < 1.05


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    checked(df, [(1, "a")], 24)
    assert S.kd_shards(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, small, capsys):
    from rill.llm.registry import op3_kd_sharding

    op3_kd_sharding(spark, small).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def by_brute_force(units, shards):
    """key -> shard: the tree grown over plain lists. units: (key, coordinates, cell, weight), none of them heavy."""
    spread = [max(1, max(u[1][d] for u in units) - min(u[1][d] for u in units)) for d in range(3)]
    homes = {}

    def grow(own, first, last):
        if last - first == 1 or not own:
            homes.update((u[0], first) for u in own)
            return
        mid = (first + last) // 2
        width = [(max(u[1][d] for u in own) - min(u[1][d] for u in own)) / spread[d] for d in range(3)]
        dim = width.index(max(width))
        goal = sum(u[3] for u in own) * (mid - first) / (last - first)

        def reached(rows, at):
            """The first value whose running weight reaches the goal, its weight, and the weight before it."""
            before = 0
            for v in sorted({at(u) for u in rows}):
                w = sum(u[3] for u in rows if at(u) == v)
                if before + w >= goal:
                    return v, w, before
                before += w

        value, _, before = reached(own, lambda u: u[1][dim])
        goal -= before
        cell, w, before = reached([u for u in own if u[1][dim] == value], lambda u: u[2])
        cell += before + w - goal < goal - before
        low = [u for u in own if (u[1][dim], u[2]) < (value, cell)]
        grow(low, first, mid)
        grow([u for u in own if u not in low], mid, last)

    grow(units, 0, shards)
    return homes


def test_tree_equals_brute_force(spark):
    """Where no unit is heavy the shards are those of a k-d tree over plain lists, ties on a coordinate included."""
    rnd = random.Random(7)
    rows = [(i, f"{i} " + "x" * rnd.randrange(20, 60), rnd.choice(["en", "fr", "de", None]), f"s{rnd.randrange(40)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = F.octet_length("text").cast("long") + 8
    own = df.select(
        "doc_id", F.array(*S.coordinates(df, ("lang", "source"), size)).alias("at"), size.alias("size"),
        F.pmod(F.xxhash64(F.xxhash64("text", size, F.lit(False))), F.lit(S.CELLS)).cast("int").alias("cell"),
    )
    units = [(r.doc_id, tuple(r["at"]), r.cell, r.size) for r in own.collect()]
    got = {r.doc_id: r.shard for r in S.kd_shards(df, 4).collect()}
    assert got == by_brute_force(units, 4)
