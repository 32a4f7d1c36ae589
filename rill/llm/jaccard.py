"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide.

1. Each text becomes the set of its 64-bit word n-gram hashes, of which only the 128-bit key of the set and its band hashes
   leave the function. Rows per band and bands are chosen for the target recall at the threshold. Texts of equal sets
   are one class (similarity 1) with a representative and a number of copies, summed before the shuffle.
2. Representatives shuffle on band hashes. Those that share a band form clusters (components of the stars around each
   bucket's smallest member, contracted to at most one edge a member and one a pair of hubs), so candidates take rows in proportion to the documents, never all
   pairs of a bucket.
3. Each cluster is verified on full sets. A cluster of one block is a unit. A larger one is cut into blocks, and each pair
   of blocks is a unit, so no task holds more than two blocks. Its members travel as differences: what a set and the cluster's
   smallest set do not have in common, from which intersections follow exactly. Near copies differ in few n-grams, so a
   member weighs some bytes however often it is sent, and texts are read once. Within a unit all pairs
   are compared by products of bounded columns of the membership matrix. What comes out is one row for each member: its
   links, counted with copies, and a tree of links.
4. Components of those trees, contracted in the same way, are the near-duplicate classes.

Every pair of texts that shares a band is compared exactly; so are all others of the same cluster.

Defined results: a text of fewer words than n, but not none, has one n-gram of all its words; a text without words or
null has no links and is a class of its own; a very long text is one set, in a block of its own if need be; repeated rows
count as copies; pairs of exactly the threshold are links; one id with different texts is as many rows,
each in the class of its text, and classes that share their smallest id share only that number. In ``near_duplicates`` rows
with a null id are not compared: they get the class of an equal text, or a null one, and count in no links; ``keep_one``
compares them as all others. An empty table gives an empty table; other columns of any names are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, settled, ship, shingle_hashes, short_lived, slices, stored, text_key, without, word_codes, words_of
from .graph import components, contracted

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 256
#: A block of a cluster: members, and n-grams together.
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1 << 19
SEED = 7
CALL_BYTES = 1_000_000

_FOUND_DDL = "node binary, links bigint, root binary"
_SIGNED_DDL = "doc_id bigint, text_key bigint, set_key binary, grams int, bands array<bigint>"


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(SEED)
    a = rnd.integers(0, 1 << 32, count, dtype=np.uint64) | np.uint64(1)
    return a.astype(np.uint32), rnd.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation; long texts go in slices of bounded memory."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        out = np.minimum(out, (a[:, None] * x[None, i : i + 4096] + b[:, None]).min(axis=1))
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    import xxhash

    parts = signature[: bands * rows].astype("<u4").reshape(bands, rows)
    found = [xxhash.xxh3_64_intdigest(p.tobytes(), seed=i) for i, p in enumerate(parts)]
    return np.array(found, np.uint64).astype(np.int64)


def gram_set(text: str | None, n: int) -> np.ndarray:
    """The ascending distinct n-gram hashes of a text."""
    return np.unique(shingle_hashes(word_codes(words_of(text)), n))


def sign_batches(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(id, key of the text, text) -> id, key, set key, size of the set and band hashes."""
    import xxhash

    a, b = multipliers(bands * rows)
    for batch in slices(batches, 2, CALL_BYTES):
        found = [words_of(t) for t in batch.column(2).to_pylist()]
        codes = word_codes([w for f in found for w in f])
        keys, sizes, own, end = [], [], [], 0
        for f in found:
            end += len(f)
            grams = np.unique(shingle_hashes(codes[end - len(f) : end], n))
            sizes.append(len(grams))
            keys.append(xxhash.xxh3_128_digest(grams.astype("<u8").tobytes()) if len(grams) else None)
            own.append(band_hashes(minhash(grams, a, b), bands, rows) if len(grams) else None)
        columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(own, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", "set_key", "grams", "bands"]
        )


def shared(owner: np.ndarray, column: np.ndarray, n: int, split: int | None) -> np.ndarray:
    """How many columns each two members have in common, from (owner, column) entries in the order of columns; with a split
    only members before it (rows) with members from it on (columns)."""
    rows = n if split is None else split
    common = np.zeros((rows, rows if split is None else n - split), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, z = np.searchsorted(column, (lo, lo + 4096))
        m = np.zeros((n, min(4096, int(column[-1]) + 1 - lo)), np.float32)
        m[owner[a:z], column[a:z] - lo] = 1
        common += m @ m.T if split is None else m[:split] @ m[split:].T
    return common


def similar(
    sets: list[np.ndarray], threshold: float, split: int | None = None, sizes: np.ndarray | None = None, base: int = 0
) -> np.ndarray:
    """Which sets have at least the Jaccard similarity, as a boolean matrix without the diagonal; with a split only pairs of one before it and one
    from it on.

    With sizes, ``sets`` are differences: what either a set of that size or a base set of ``base`` has alone. Of
    |d| elements in a difference, lost = (|d| + base - size) / 2 are the base's. Two sets have in common
    base - lost - lost' and what both differences hold."""
    n = len(sets)
    alone = np.array([len(s) for s in sets], np.float64)
    size = alone if sizes is None else np.asarray(sizes, np.float64)
    lost = (alone + base - size) / 2
    all_, owner = np.concatenate(sets), np.repeat(np.arange(n), alone.astype(np.int64))
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    column = np.cumsum(np.concatenate(([True], all_[1:] != all_[:-1]))[: len(all_)]) - 1
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[often], column[often]
    if len(column):
        column = np.cumsum(np.concatenate(([0], np.diff(column) != 0)))
    common = shared(owner, column, n, split)
    near = np.zeros((n, n), bool)
    left, right = (slice(None), slice(None)) if split is None else (slice(split), slice(split, None))
    common += base - lost[left, None] - lost[None, right]
    close = common * (1 + threshold) >= threshold * (size[left, None] + size[None, right]) - 1e-6
    near[left, right] = close
    if split is not None:
        near[right, left] = close.T
    np.fill_diagonal(near, False)
    return near


def roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that links lead to."""
    label = ids.copy()
    while True:
        reach = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1) if len(ids) else label
        new = np.minimum(label, reach)
        if (new == label).all():
            return label
        label = new


def compared(rows: list[tuple], sets: list[np.ndarray], threshold: float, split: int | None, sizes=None, base: int = 0) -> pa.RecordBatch:
    """node, links and root of a unit's rows (unit, block, node, copies, …), which are in the order of blocks and nodes."""
    nodes = [r[2] for r in rows]
    rank = np.empty(len(nodes), np.int64)
    rank[sorted(range(len(nodes)), key=nodes.__getitem__)] = np.arange(len(nodes))
    near = similar(sets, threshold, split, sizes, base)
    by_rank = np.argsort(rank)
    root = [nodes[by_rank[i]] for i in roots(near, rank)]
    links = near @ np.array([r[3] for r in rows], np.int64)
    columns = [pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows come sorted by their first column; those of one value together."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def verify_texts(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Clusters of one block: (unit, block, node, copies, text)."""
    for rows in units_of(batches):
        yield compared(rows, [gram_set(r[4], n) for r in rows], threshold, None)


def difference_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Blocks of large clusters, (block key, node or null, text), the base's text first and without a node -> node and its
    difference, with the base's size. One set is held besides the base."""
    key, base = None, None
    for batch in slices(batches, 2, CALL_BYTES):
        out: list[tuple] = []
        for own, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            grams = gram_set(text, n)
            if own != key:
                key, base = own, grams
            if node is not None:
                out.append((node, len(base), np.setxor1d(grams, base, assume_unique=True).astype("<u8").tobytes()))
        nodes, sizes, bodies = zip(*out) if out else ((), (), ())
        columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "base", "body"])


def verify_differences(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: (unit, block, node, copies, grams, base, difference, whether the blocks are two)."""
    for rows in units_of(batches):
        rows.sort(key=lambda r: (r[1], r[2]))
        split = next((i for i, r in enumerate(rows) if r[1] != rows[0][1]), None)
        if rows[0][7] and split is None:  # one of the two blocks is empty
            continue
        sets = [np.frombuffer(r[6], "<u8") for r in rows]
        yield compared(rows, sets, threshold, split, np.array([r[4] for r in rows]), rows[0][5])


def near_duplicates(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, class_id (the smallest id that links lead to), rep_id (the smallest id of the same n-gram set) and n_links
    (other rows of at least the similarity) of every row."""
    return classified(docs, n, threshold, recall, doc_id, text).drop("text_key", "label")


def classified(docs: DataFrame, n: int, threshold: float, recall: float, doc_id: str, text: str, null_ids: bool = False) -> DataFrame:
    """near_duplicates with a hash of each row's text and the label of its component. An n-gram set is a node, named by its key, so ids that repeat with different texts stay apart; a label is a node, so classes do too.

    null_ids: rows with a null id are compared as well; the smallest id of a class is then null where it has no other."""
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))

    def sign(batches):
        yield from settled(sign_batches(batches, n, bands, rows))

    signed = stored(given.mapInArrow(sign, _SIGNED_DDL), "signed")
    with_words = signed.where("set_key is not null" if null_ids else "set_key is not null and doc_id is not null")
    reps = with_words.groupBy("set_key").agg(
        F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key")).alias("first"),
        F.count("*").alias("copies"),
        F.first("grams").alias("grams"),
        F.first("bands").alias("bands"),
    )
    reps = reps.select(F.col("set_key").alias("node"), F.col("first.doc_id").alias("rep"), "first.text_key", "copies", "grams", "bands")
    reps = stored(reps, "reps")
    linked, forest = verified(given, reps, n, threshold)
    labels = components(forest)
    ids = labels.join(reps.select("node", "rep"), "node")
    classes = ids.groupBy("label").agg(F.min("rep").alias("class_id"))
    known = (
        reps.select("node", "rep", "copies")
        .join(linked, "node", "left")
        .join(labels.join(classes, "label").select("node", "label", "class_id"), "node", "left")
        .select(
            F.col("node").alias("set_key"),
            F.coalesce("label", "node").alias("label"),
            "rep",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("class_id", "rep").alias("class_id"),
        )
    )
    return signed.select("doc_id", "text_key", "set_key").join(known, "set_key", "left").select(
        "doc_id",
        "text_key",
        "label",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("rep_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def verified(given: DataFrame, reps: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) of the sets with candidates, and a forest of links (a, b)."""
    # Clusters only propose, so short names do: sets whose names collide share a cluster and are compared for nothing.
    named = reps.withColumn("name", F.xxhash64("node"))
    entries = named.select("name", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("name").alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = entries.join(buckets, "band").where("name <> hub").select(F.col("name").alias("a"), F.col("hub").alias("b"))
    clusters = components(stored(contracted(hubs), "stars"))
    member = clusters.withColumnRenamed("node", "name").join(named.select("name", "node", "rep", "text_key", "copies", "grams"), "name").drop("name")
    sizes = member.groupBy("label").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.col("grams").cast("long")) / BLOCK_GRAMS)).cast("int").alias("blocks"),
        F.min(F.struct("grams", "node")).getField("node").alias("base"),
    )
    # Few rows beside the members, and only of members that have candidates; a large cluster's row meets all its members, so
    # that adaptive execution splits its side.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = stored(member.join(sizes, "label").withColumn("block", block), "units")
    # The first row of each set, whose text stands for it.
    wanted = units.select(F.col("rep").alias("doc_id"), "text_key")
    maybe = flagged(given, wanted, ["doc_id", "text_key"], "maybe").where("maybe").drop("maybe")
    first = units.select("node", "rep", F.col("text_key").alias("own_key"))
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("own_key"))
    texts = maybe.join(first, same).groupBy("node").agg(F.first("text").alias("text"))
    small = units.where("blocks = 1").join(texts, "node").select(F.col("label").alias("unit"), "block", "node", "copies", "text")
    dealt = small.repartition("unit").sortWithinPartitions("unit", "block", "node")

    def verify(batches):
        yield from settled(verify_texts(batches, n, threshold))

    found = stored(dealt.mapInArrow(verify, _FOUND_DDL), "verified")
    large = units.where("blocks > 1")
    if large.limit(1).count():
        found = found.unionByName(in_blocks(large, texts, n, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots_ = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return links, stored(contracted(roots_), "forest")


def in_blocks(large: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, links and root of the members of clusters of several blocks, a row for each unit that a member is in."""
    read = stored(large.select("node", "label", "block").join(texts, "node"), "texts")
    # A base goes once to every block of its cluster: a row for BLOCK_ROWS members or BLOCK_GRAMS n-grams.
    bases = large.where("node = base").select("node", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    bases = bases.join(read.select("node", "text"), "node").select("label", "block", F.lit(None).cast("binary").alias("node"), "text")
    key = F.concat_ws(",", "label", "block").alias("key")
    rows = read.unionByName(bases).select(key, "node", "text")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("node").asc_nulls_first())

    def shorten(batches):
        yield from settled(difference_batches(batches, n))

    short = stored(dealt.mapInArrow(shorten, "node binary, base int, body binary"), "differences")
    sent = large.drop("base").join(short, "node")
    # Block i meets every block j: in unit (min, max).
    paired = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    unit = F.concat_ws(",", "label", low, high).alias("unit")
    rows = paired.select(unit, "block", "node", "copies", "grams", "base", "body", (low != high).alias("pair"))
    dealt = rows.repartition("unit").sortWithinPartitions("unit")

    def verify(batches):
        yield from settled(verify_differences(batches, threshold))

    return stored(dealt.mapInArrow(verify, _FOUND_DDL), "compared")


def keep_one(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with one row of each near-duplicate class: the one with the smallest id, null being the last (of rows with that
    id, one with the text whose key comes first); rows without words stay."""
    with short_lived():  # what follows reads docs, the rows that go and the rows chosen
        found = classified(docs, n, threshold, recall, doc_id, text, null_ids=True).where("n_links > 0")
        # A class is a component, whatever ids it shares with others.
        texts = stored(found.groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("rows")), "texts")
        first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "rows"))
        chosen = texts.groupBy("label").agg(first.alias("kept")).select("label", "kept.id", "kept.key", F.col("kept.rows").alias("copies"))
        chosen = stored(chosen, "chosen", lasts=True)
        gone = texts.join(chosen, "label").where(~F.col("doc_id").eqNullSafe(F.col("id")) | (F.col("text_key") != F.col("key")))
        rest = without(docs, gone.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")), doc_id, text)
    twice = chosen.where("copies > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    if not twice.limit(1).count():
        return rest
    # Rows repeated with id and text: one of each.
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (text_key(F.col(text)) == F.col("_key"))
    once = rest.join(twice, same, "left_semi").dropDuplicates([doc_id, text])
    return rest.join(twice, same, "left_anti").unionByName(once)


def brute_force(docs: list[tuple[int, str | None]], n: int = N, threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """doc_id -> (class_id, n_links) by comparing all pairs of Python sets."""
    sets = []
    for i, t in docs:
        w = words_of(t)
        k = min(n, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()))
    label, links = {i: i for i, _ in sets}, {i: 0 for i, _ in sets}
    edges = [
        (i, j)
        for x, (i, s) in enumerate(sets)
        for j, t in sets[x + 1 :]
        if s and t and len(s & t) >= threshold * len(s | t) - 1e-9
    ]
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return {i: (label[i], links[i]) for i, _ in sets}
