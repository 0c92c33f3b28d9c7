"""What several operators share: tables, whole texts as bytes, hashes, components.

Texts reach Python as Arrow buffers.  Everything per byte is done by numpy over
slices of about ``SLICE`` bytes, so memory does not follow the batch or the text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealtable.session import work_path

SLICE = 1 << 20
# A table of at most this many narrow rows may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def collect_rarely() -> None:
    """Workers that keep large dictionaries spend much time in Python's cycle collector,
    which walks all of them again and again; what is loaded now is left out of it."""
    gc.collect()
    gc.freeze()
    gc.set_threshold(200_000, 20, 100)


# Bytes that go to a Python worker at once, unless the session asks for less.  Spark's 64 MB
# are held several times over: as Arrow buffers in the JVM, in the pipe and in the worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with the memory that is free before each given back: workers live on from
    stage to stage, and what one stage freed would otherwise stay with them in the next."""
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        trim = None
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)
        yield batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and
    every later reader sees the same rows even if an executor is lost."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames made by ``stored``, once nothing that will still be
    read depends on them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes what a query has shuffled once that query has ended.  Otherwise the
    files of all of a job's queries stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def placed(df: DataFrame, group: list[str], order: list[str], label: str, name: str) -> DataFrame:
    """The rows with their place, from 0, in their group.  Groups may have any size: rows are
    dealt by ranges of group and order, and one count per group and range is summed up.  The
    ordered rows are written to the shared folder, as both steps need the same ranges.  Rows
    equal in ``group`` and ``order`` get places in no particular order."""
    keys = [*group, *order, "_tie"]
    rows = stored(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")),
        label,
    )
    key = F.struct("_range", *group).alias("_key")  # a null equals itself in this form
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*[F.col("_key")[c] for c in group], F.lit(0)).orderBy("_key._range")
    before = F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_key", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    found = rows.withColumn("_key", key).join(starts, "_key")
    return found.select(*df.columns, (F.col("_start") + F.col("_at")).alias(name))


def small(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if a count shows it is small, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each, one row at least."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


# Polynomial hash modulo 2^64 of runs of words from prefix sums: the base is odd, so it has
# an inverse and the position can be divided out.  Only for short runs of hashes: long
# patterned ones can collide.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    have = 1
    while have < count:
        step = min(have, count - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if count > len(_tables.get("up", ())):
        size = max(count, SLICE + 1)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Spans of at most this many bytes are hashed by eights, all at once; longer ones are rare.
SHORT = 24
_LANE = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(_INVERSE))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; equal bytes give equal hashes.  Eight bytes are
    mixed in at a time by a bijection, longer spans are left to xxh3, so no pattern in the
    bytes makes hashes equal, as one does for polynomials modulo a power of two."""
    length = (end - start).astype(np.int64)
    out = mixed(length.astype(np.uint64) ^ _LANE[3])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for lane in range(SHORT // 8):
        rows = np.flatnonzero((length > 8 * lane) & (length <= SHORT))
        if not len(rows):
            break
        value = eights[start[rows] + 8 * lane] & _FIRST_BYTES[np.minimum(8, length[rows] - 8 * lane)]
        out[rows] = mixed(out[rows] ^ value) + _LANE[lane]
    long = np.flatnonzero(length > SHORT)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        spans = zip(start[long].tolist(), end[long].tolist())
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(long))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than blank, tab and line breaks."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A text cut at blanks into pieces of about SLICE bytes."""
    first = 0
    while first < len(data):
        last = min(len(data), first + SLICE)
        while last < len(data):
            blank = np.flatnonzero(_SPACE[data[last : last + SLICE]])
            if len(blank):
                last += int(blank[0])
                break
            last = min(len(data), last + SLICE)
        yield first, last
        first = last


def word_hashes(at: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of rows first to last, and how many words
    each row has.  Words of several rows never merge: rows are marked by offset."""
    base = int(at[first])
    data = _LOWER[raw[base : int(at[last])]]
    if last - first == 1 and len(data) > 2 * SLICE:
        parts = []
        for a, b in _pieces(data):
            s, e = word_spans(data[a:b])
            parts.append(span_hashes(data[a:b], s, e))
        out = np.concatenate(parts)
        return out, np.array([len(out)])
    # A blank between rows: spans are found on a copy with one blank after each row.
    rows = last - first
    ends = at[first + 1 : last + 1] - base
    spread = np.insert(data, ends, 0x20) if rows > 1 else data
    s, e = word_spans(spread)
    row_end = ends + np.arange(1, rows + 1)
    counts = np.diff(np.searchsorted(s, np.r_[0, row_end]))
    return span_hashes(spread, s, e), counts


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles); a text with fewer words gives one
    shingle of all of them, a text without words an empty array."""
    at, raw = buffers(column)
    for first, last in slices(at):
        hashes, counts = word_hashes(at, raw, first, last)
        begin = np.r_[0, np.cumsum(counts)]
        if len(hashes) >= words:
            grams = hashes[: len(hashes) - words + 1].copy()
            for k in range(1, words):
                grams = mixed(grams + np.uint64(k)) + hashes[k : len(hashes) - words + 1 + k]
            grams = mixed(grams)
        for row in range(first, last):
            a, n = int(begin[row - first]), int(counts[row - first])
            if n >= words:
                yield row, np.unique(grams[a : a + n - words + 1])
            elif n:
                h = hashes[a : a + 1].copy()
                for k in range(1, n):
                    h = mixed(h + np.uint64(k)) + hashes[a + k : a + k + 1]
                yield row, mixed(h + np.uint64(n << 32))
            else:
                yield row, np.zeros(0, np.uint64)


def longs(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed 64-bit numbers that Spark keeps."""
    return np.ascontiguousarray(values).view(np.int64)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list value per array."""
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)`` for every id in ``edges (a, b)``; component is the smallest id
    that links reach.  Alternating large-star and small-star steps: each node hands its
    neighbours to its least neighbour until only stars are left.  Each step is one
    aggregation and one join; its rows are stored, those of the step before are deleted, and
    only their count and sum come to the driver."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, label)
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large, label)
        # Now every pair has v < u, so v ranges over the smaller neighbours of u.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        step = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, pairs = pairs, stored(step.where("u <> v").distinct(), label)
        discard(before, large)
        now = pairs.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
