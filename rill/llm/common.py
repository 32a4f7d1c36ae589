"""What the operators share: reading tables, stored intermediate tables, word splitting, hashing.

Definitions used throughout:

* word: after lower-casing A-Z, a maximal run of characters other than ASCII characters that are neither
  digits nor lower-case letters. All characters beyond ASCII are word characters. A null text has no words.
* stored table: a Parquet table in the shared folder of ``spark.checkpoint.dir``. It cuts lineage, survives the
  loss of any executor, and gives the planner the real size of what it may broadcast.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space; UTF-8 bytes stay.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: The vocabulary folder of the public tokenizers.
TOKENIZER_DIR = "/opt/tokenizers"

#: Spark's bound on the bytes of an Arrow batch, and its default.
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, by the package that owns it or by its usual folder."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """One folder of this session below ``spark.checkpoint.dir`` or the folder given to ``setCheckpointDir``. Where neither is set,
    a local session uses /tmp/checkpoints; on a cluster, whose machines would not share that, it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = chosen.get() if chosen.isDefined() else None
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file:///tmp/checkpoints"
        _folders[app] = f"{base.rstrip('/')}/rill-{app}-{uuid.uuid4().hex[:8]}"
        if _folders[app].startswith("file:"):
            atexit.register(shutil.rmtree, "/" + _folders[app].removeprefix("file:").lstrip("/"), ignore_errors=True)
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a new table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: What the innermost block of ``short_lived`` has stored.
_passing: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


@contextmanager
def short_lived() -> Iterator[None]:
    """Deletes, at its end, the tables that were stored meanwhile but not to last: for operators whose result reads no more than the rows
    given and a stored decision."""
    made: list[DataFrame] = []
    token = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(token)
        discard(*made)


def stored(df: DataFrame, name: str, lasts: bool = False) -> DataFrame:
    """Writes df to the shared folder once and returns the table written. lasts: beyond a block of ``short_lived`` too."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if not lasts and (made := _passing.get()) is not None:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        at, fs = hadoop_path(t.sparkSession, t._stored_at)
        fs.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all stored tables of this session; frames that read them stop working."""
    at, fs = hadoop_path(spark, shared_folder(spark))
    fs.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors, also where they do not share the driver's Python path: a zip of its
    sources in the shared folder, added once to a session. Arrow batches, which hold whole texts here, get a bound of 8 MB
    unless the session has set one of its own."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, "8m")
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    name = f"{root.name}_package.zip"
    if any(os.path.basename(f) == name for f in getattr(sc, "_python_includes", [])):
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    at, fs = hadoop_path(spark, f"{shared_folder(spark)}/{name}")
    out = fs.create(at)
    out.write(body.getvalue())
    out.close()
    sc.addPyFile(f"{shared_folder(spark)}/{name}")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, in the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def settled(batches: Iterator) -> Iterator:
    """The batches, and what their making took from the machine given back at the end: workers live on between tasks."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return [] if text is None else utf8(text).translate(WORD_TABLE).split()


def utf8(text: str) -> bytes:
    """UTF-8 of a text; lone surrogates, which UTF-8 has not, become question marks."""
    return text.encode("utf-8", "replace")


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with at most ``most`` bytes in a text column, one row at least: views, no copies."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        i = 0
        while i < len(ends):
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(i, j - i)
            i = j


def by_bytes(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into runs [i, j) of at most ``most`` bytes of UTF-8, one text at least."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if t.isascii() else len(utf8(t))
        if j > i and size + n > most:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def text_key(text):
    """A hash that tells rows of one id with different texts apart."""
    return F.xxhash64(text, F.isnull(text))


#: A key of more rows than this, and than a HOT_KEYS-th of all, is dealt SALTS ways; there are at most HOT_KEYS such keys.
HOT_ROWS, HOT_KEYS, SALTS = 20_000, 10_000, 64


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """The keys of so many of the total rows that one task should not gather them, if there are any: HOT_KEYS at most."""
    if total <= HOT_ROWS:
        return None
    return hot_among(rows.groupBy(key).agg(F.count("*").alias("rows")), key, total)


def hot_among(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """hot_keys by their counts (key, rows)."""
    if total <= HOT_ROWS:
        return None
    many = stored(counts.where(F.col("rows") > max(HOT_ROWS, total / HOT_KEYS)).select(key), "hot")
    return many if many.limit(1).count() else None


def looked_up(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None, spread: str) -> DataFrame:
    """rows with table's columns by ``key``, one row of table for each; rows of hot keys are dealt by a hash of ``spread``, and the
    table's rows of those keys are repeated for each deal."""
    if hot is None:
        return rows.join(table, key)
    marks = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # HOT_KEYS rows at most
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(marks, key, "left").withColumn("_salt", salt).drop("_hot")
    repeated = table.join(marks, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")


#: Bits of the filter below: it takes 4 MB at most, whatever it stands for.
FILTER_BITS = 1 << 24


def flagged(rows: DataFrame, listed: DataFrame, keys: list, flag: str) -> DataFrame:
    """Adds a boolean: false where a row's keys are surely not in listed (whose columns are in the order of keys).

    A bitmap of hashes, of bounded size, goes to all tasks, so that a join with listed need not shuffle most of rows. The
    more rows are listed, the more pass: it saves work and decides nothing."""
    slot = F.pmod(F.xxhash64(*listed.columns), F.lit(FILTER_BITS)).alias("slot")
    word = F.expr("shiftright(slot, 6)").alias("_word")
    bits = listed.select(slot).groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("_bits"))
    own = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    # bits has FILTER_BITS / 64 rows of two numbers at most.
    found = rows.withColumn("_slot", own).join(F.broadcast(bits), F.expr("shiftright(_slot, 6)") == F.col("_word"), "left")
    held = F.coalesce(F.expr("(shiftright(_bits, cast(_slot % 64 as int)) & 1L) = 1"), F.lit(False))
    return found.withColumn(flag, held).drop("_slot", "_word", "_bits")


def without(rows: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rows, with all columns, less those whose id and text are in gone (id, key); a null id is an id.

    Rows that are surely not in gone skip the join, so texts that stay are not shuffled."""
    listed = stored(gone.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct(), "gone", lasts=True)
    key, own = F.col(doc_id).cast("long"), text_key(F.col(text))
    seen = flagged(rows, listed, [key, own], "_maybe")
    same = key.eqNullSafe(F.col("_gone_id")) & (own == F.col("_gone_key"))
    rest = seen.where("_maybe").join(listed, same, "left_anti")
    return seen.where("not _maybe").unionByName(rest).drop("_maybe")


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit code for each word (the same on every machine)."""
    import xxhash

    seen: dict[bytes, int] = {}
    get, h = seen.get, xxhash.xxh3_64_intdigest
    out = [0] * len(words)
    for i, w in enumerate(words):
        c = get(w)
        if c is None:
            c = seen[w] = h(w)
        out[i] = c
    return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser with two multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words; a text of fewer words, but not none, is one run."""
    m = len(codes)
    if not m:
        return np.empty(0, np.uint64)
    k = min(n, m)
    h = np.full(m - k + 1, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        h = mix(h ^ codes[j : m - k + 1 + j]) + np.uint64(j + 1)
    return h


def arrow_table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def ranked(df: DataFrame, group: list, order: list, name: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 in each group, without gathering a group in one task.

    Rows of a group are dealt by a hash of ``order`` into buckets of about per_bucket rows; a row's rank is its rank
    in its bucket plus the rows in earlier buckets. ``rows`` is a known count of df's rows; df is read twice.
    """
    from pyspark.sql import Window as W

    buckets = max(1, -(-rows // per_bucket))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    ).select(*group, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = keyed.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)).cast("long") - 1
    )
    return (
        inside.join(before, [*group, "_bucket"])
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_rank", "_before", "_bucket")
    )
