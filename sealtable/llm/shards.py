"""Operator 9: training order as fixed-stride binary shards.

The texts a task reads become one stream of token ids, each text followed by the final
id, cut into sequences of ``length`` tokens (the task's last one is filled up).  A
sequence's index is its number in the task and the task's number, interleaved.  A keyed
Feistel network over the next even power of two, walked until it lands inside the domain,
permutes all indexes; its value is the sequence's key in training order.  Keys spread
evenly, so equal ranges of keys are shards of nearly equal size and need no sampling: one
shuffle deals the sequences to the shards, each is sorted by key and written by one task.
A sequence's global slot is the number of sequences in the shards before its own plus its
place in the shard, so slots have no gaps and no sequence is tokenised twice.

A record is a header (first document's id, tokens of it that came before, real tokens,
CRC-32 of the tokens, key), the ids as unsigned 16-bit numbers, all little-endian, and a
line break.  Its stride is fixed, so reading can begin at any slot.

Defined cases: a null or empty text is its final id alone; a row without id has the
smallest 64-bit number as its id; repeated rows give their tokens again; other columns are
never read; an empty table gives one shard folder without files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import calcsize, pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealtable.llm import common, library
from sealtable.session import work_path

LENGTH, END_ID, KEY, ROUNDS = 1024, 0, 0x5EA17AB1E, 4
# Sequences in a shard, about.
SHARD_ROWS = 8192
HEADER = "<qqIIq"


def stride(length: int) -> int:
    return calcsize(HEADER) + 2 * length + 1


def _feistel(x: np.ndarray, half: int, key: int) -> np.ndarray:
    """A permutation of the numbers below 4 ** half."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in range(ROUNDS):
        salt = np.uint64((key * (2 * k + 1) + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        left, right = right, left ^ (common.mixed(right + salt) & mask)
    return left << np.uint64(half) | right


def permuted(index: np.ndarray, domain: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of the numbers below ``domain``: the network covers the next
    power of four, and values outside walk on along their cycle until one is inside."""
    half = max(1, -(-(domain - 1).bit_length() // 2))
    out = _feistel(index.astype(np.uint64), half, key)
    while (outside := np.flatnonzero(out >= domain)).size:
        out[outside] = _feistel(out[outside], half, key)
    return out


def sequences(docs: DataFrame, length: int, domain_tasks: int, domain: int, key: int, path: str) -> DataFrame:
    """``(key, record)`` of every sequence of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library.token_ids(path, 2)
        task = TaskContext.get().partitionId()
        final = END_ID.to_bytes(2, "little")
        stream, at, number = bytearray(), 0, 0
        marks: list[tuple[int, int]] = []  # where documents begin in the stream, and their ids

        def take(size: int) -> pa.RecordBatch:
            nonlocal stream, number, marks
            rows = size // (2 * length)
            if task >= domain_tasks or (number + rows) * domain_tasks > domain + domain_tasks:
                raise RuntimeError("the tasks that read the texts changed since they were counted")
            keys = permuted((number + np.arange(rows)) * domain_tasks + task, domain, key)
            places = np.array([m for m, _ in marks])
            first = np.searchsorted(places, np.arange(rows) * 2 * length, "right") - 1
            records = []
            for k, f in enumerate(first.tolist()):
                a = 2 * length * k
                ids = bytes(stream[a : a + 2 * length])
                real = len(ids) // 2
                ids = ids.ljust(2 * length, b"\0")
                place, doc = marks[f]
                head = pack(HEADER, doc, (a - place) // 2, real, zlib.crc32(ids[: 2 * real]), int(keys[k]))
                records.append(head + ids)
            number += rows
            kept = int(np.searchsorted(places, size, "right")) - 1
            del stream[:size]
            marks = [(m - size, d) for m, d in marks[max(kept, 0) :]]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(records, pa.binary())], ["key", "record"]
            )

        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_pylist()
            for row, doc in enumerate(ids):
                marks.append((len(stream), doc))
                stream += codec.encode(batch.column(1)[row].as_py() or "") + final
                if len(stream) >= 256 * 2 * length:
                    yield take(len(stream) // (2 * length) * 2 * length)
        if stream:
            whole = -(-len(stream) // (2 * length)) * 2 * length
            yield take(whole)

    return docs.mapInArrow(run, "key long, record binary")


def write_shards(
    docs: DataFrame,
    folder: str,
    length: int = LENGTH,
    shard_rows: int = SHARD_ROWS,
    key: int = KEY,
    path: str = library.RANKS,
) -> None:
    """Writes ``docs (doc_id, text)`` as ``shard=N`` folders with one file each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A text has a token a byte at most, so no task has more sequences than its bytes fill.
    sizes = docs.groupBy(F.spark_partition_id().alias("task")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")
    )
    most, total = sizes.agg(F.max("bytes"), F.sum("bytes")).first()
    tasks = docs.rdd.getNumPartitions()
    domain = max(1, tasks * -(-(most or 0) // length))
    shards = max(1, -(-(total or 0) // (3 * length * shard_rows)))
    made = sequences(docs, length, tasks, domain, key, path)
    width = -(-domain // shards)
    made = made.withColumn("shard", F.floor(F.col("key") / width).cast("int"))
    made = made.repartitionById(shards, "shard").sortWithinPartitions("shard", "key")
    # The text writer puts bytes down as they are and ends each record with a line break.
    lines = made.select("shard", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("shard").option("compression", "none").text(folder)


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH) -> DataFrame:
    """Every record: ``shard, place, doc_id, start, n_tokens, ids_crc32, key, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "place", "doc_id", "start", "n_tokens", "ids_crc32", "key", "ids"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        size = stride(length)
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                if raw.size % size:
                    raise ValueError(f"shard {shard} is not made of records of {size} bytes")
                view = memoryview(raw)
                for first in range(0, raw.size, 1000 * size):
                    rows = []
                    for at in range(first, min(first + 1000 * size, raw.size), size):
                        doc, start, n, crc, key = unpack_from(HEADER, view, at)
                        a = at + calcsize(HEADER)
                        ids = bytes(view[a : a + 2 * n])
                        if zlib.crc32(ids) != crc:
                            raise ValueError(f"shard {shard} is damaged at byte {at}")
                        rows.append((shard, at // size, doc, start, n, crc, key, ids))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "shard int, place long, doc_id long, start long, n_tokens long, ids_crc32 long, key long, ids binary"
    return _files(spark, folder).select("shard", "content").mapInArrow(run, schema)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """All shard files; a folder without shards has no rows."""
    files = spark.read.format("binaryFile").load(folder)
    return files if "shard" in files.columns else files.withColumn("shard", F.lit(None).cast("int")).where("false")


def with_slots(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """``slot``: records in the shards before, plus the place in the own shard.  ``sizes``
    has one row per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return records.join(F.broadcast(starts), "shard").withColumn("slot", F.col("base") + F.col("place")).drop("base")


def shard_sizes(spark: SparkSession, folder: str, length: int = LENGTH) -> DataFrame:
    """``(shard, rows)`` from file lengths; no file is opened."""
    return _files(spark, folder).groupBy("shard").agg(F.floor(F.sum("length") / stride(length)).cast("long").alias("rows"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in training order and read back, one row per sequence: its
    slot, where its record is, and the document its first token belongs to."""
    folder = work_path(spark, "shards")
    write_shards(common.table(spark, sf_dir, "documents"), folder)
    records = with_slots(read_shards(spark, folder), shard_sizes(spark, folder))
    return records.select(
        "slot",
        "shard",
        (F.col("place") * stride(LENGTH)).alias("byte_offset"),
        "doc_id",
        "start",
        "n_tokens",
        "ids_crc32",
        F.sha2("ids", 256).alias("ids_sha256"),
    )
