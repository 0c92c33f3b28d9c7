"""Operator 7: document fingerprints from closed syncmers.

A window of ``K`` bytes is an anchor when the least hash among its ``K - S + 1`` inner
substrings of ``S`` bytes lies at its first or last place.  Whether it does depends on
the window alone, so an edit changes only the anchors that overlap it, and a long text
may be read in segments.  A fingerprint holds the ``SIZE`` least hashes of all anchors
(a bottom sketch); the likeness of two is the share of common hashes among the ``SIZE``
least of both, an estimate of the Jaccard similarity of the anchor sets.

Defined cases: a null or empty text has an empty fingerprint; texts shorter than ``K``
bytes are one anchor; equal fingerprints, two empty ones included, have likeness 1.
Rows are ordered by id with a null id first, rows of one id by their text; the row after
the last is the first.  Other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common

K, S, SIZE = 16, 8, 96
_FIRST = -(1 << 63)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text's bytes, in order."""
    if len(data) < K:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = common.span_hashes(data, np.array([0]), np.array([len(data)]))
        return np.array([0]), whole
    places, hashes = [], []
    for first in range(0, len(data) - K + 1, common.SLICE):
        words = _words(data[first : first + common.SLICE + K - 1])
        inner = common.mixed(words)
        low = np.minimum(inner[:-1], inner[1:])
        low = np.minimum(low[:-2], low[2:])
        low = np.minimum(low[:-4], low[4:])
        low = np.minimum(low[:-1], inner[8:])
        at = np.flatnonzero((low == inner[: len(low)]) | (low == inner[8:]))
        places.append(at + first)
        hashes.append(common.mixed(inner[at] * np.uint64(3) + words[at + 8]))
    return np.concatenate(places), np.concatenate(hashes)


def fingerprint(text: bytes, size: int = SIZE) -> np.ndarray:
    """The least 32-bit hashes of the text's anchors, sorted."""
    hashes = anchors(np.frombuffer(text, np.uint8))[1]
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the anchor sets behind two fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[:-1] == both[1:]
    distinct = len(both) - int(same.sum())
    if distinct <= size:
        return int(same.sum()) / distinct
    # Only hashes among the least of the union count; what a sketch cut off is above.
    union = np.unique(both)[:size]
    return int(np.isin(union, both[:-1][same], assume_unique=False).sum()) / size


def _hex(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint)`` per row; fingerprint is hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [_hex(fingerprint(t.encode())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(prints)],
                ["id", "n_chars", "fingerprint"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string")


def _order(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(_FIRST).to_numpy(zero_copy_only=False)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``(bucket, guest, at, tie, doc_id, text)``: rows dealt to ranges of ids, each with
    a copy of the row that follows its last one as a guest.  One shuffle of the texts;
    the driver sees one number per range."""
    ids = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("at"))
    cuts = ids.approxQuantile("at", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(bounds, at, "right")
            order = np.lexsort((at, bucket))
            first = np.unique(bucket[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(first[0]), pa.array(at[order][first[1]])], ["bucket", "at"])

    least = ids.mapInArrow(heads, "bucket long, at long").groupBy("bucket").agg(F.min("at").alias("at"))
    first = sorted((r["bucket"], r["at"]) for r in least.collect())
    # The head of each range visits the range before it, the first head the last range.
    visits = {at: first[k - 1][0] for k, (_, at) in enumerate(first)}
    hosts = np.array(sorted(visits), np.int64)
    targets = np.array([visits[h] for h in hosts.tolist()], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "guest", "at", "doc_id", "text"]
        for batch in batches:
            at = _order(batch.column(0))
            bucket = np.searchsorted(bounds, at, "right")
            own = [pa.array(bucket), pa.array(np.zeros(len(at), np.int32)), pa.array(at), *batch.columns]
            yield pa.RecordBatch.from_arrays(own, names)
            found = np.searchsorted(hosts, at)
            rows = np.flatnonzero(hosts[np.minimum(found, len(hosts) - 1)] == at) if len(hosts) else []
            if len(rows):
                copy = batch.take(pa.array(rows))
                guest = [pa.array(targets[found[rows]]), pa.array(np.ones(len(rows), np.int32)), pa.array(at[rows])]
                yield pa.RecordBatch.from_arrays([*guest, *copy.columns], names)

    dealt = docs.select("doc_id", "text").mapInArrow(
        deal, "bucket long, guest int, at long, doc_id long, text string"
    )
    return dealt.withColumn("tie", F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the start of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def edit_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text of ``docs (doc_id, text)``, of its edited text, and how
    like they are to each other and to the next document's."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts or 4 * tasks)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # bucket, id, text and fingerprint of the row that waits for its next
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                out = []
                batch = whole.slice(at, 1000).to_pydict()
                for bucket, guest, doc_id, text in zip(*(batch[c] for c in ("bucket", "guest", "doc_id", "text"))):
                    if guest and (before is None or before[0] != bucket):
                        continue
                    text = text or ""
                    own = fingerprint(text.encode())
                    if before is not None and before[0] == bucket:
                        new = edited(before[2], text).encode()
                        other = fingerprint(new)
                        out.append(
                            (
                                before[1],
                                len(before[2]),
                                hashlib.sha256(new).hexdigest(),
                                _hex(before[3]),
                                _hex(other),
                                likeness(before[3], other),
                                likeness(before[3], own),
                            )
                        )
                    before = None if guest else (bucket, doc_id, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=_SCHEMA)

    one = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "guest", "at", "tie")
    return one.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    ).select(*names)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    return edit_likeness(common.table(spark, sf_dir, "documents"))
