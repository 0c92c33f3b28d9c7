"""Operator 5: byte-level BPE encoding and decoding with a hierarchical-bitmap queue.

Pre-tokens are doubly linked lists of parts.  Each mergeable neighbour pair waits in
the bucket of its rank; a bitmap of two levels, 256 ranks to a word, marks the buckets in
use, so "lowest rank" is two find-first-set steps.  A merge only appends to
buckets: an entry whose pair has changed since is stale and skipped when it is popped.
n bytes cost O(n log n) however long a pre-token is.  The pre-tokens of a few hundred
texts that a task has not met before go through one queue together.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no
bytes; repeated rows and ids each give a row; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from struct import pack

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common, pretokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
_BIT = [1 << k for k in range(1 << 12)]
# Encoded pre-tokens a worker remembers; it starts afresh beyond this number.
MEMO = 400_000
# Longer pre-tokens are not worth remembering.
MEMO_BYTES = 64


class RankQueue:
    """Positions by rank, with the lowest rank found through two levels of bitmaps: a
    top word with a bit for each group of 256 ranks, and a word for each group."""

    __slots__ = ("top", "groups", "buckets")

    def __init__(self):
        self.top = 0
        self.groups: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            buckets[rank].append(position)
            return
        buckets[rank] = [position]
        group = rank >> 8
        groups = self.groups
        if group in groups:
            groups[group] |= _BIT[rank & 255]
        else:
            groups[group] = _BIT[rank & 255]
            self.top |= _BIT[group]

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and all positions waiting for it, leftmost first."""
        top = self.top
        group = (top & -top).bit_length() - 1
        bits = self.groups[group]
        low = bits & -bits
        if bits == low:
            del self.groups[group]
            self.top = top ^ _BIT[group]
        else:
            self.groups[group] = bits ^ low
        rank = (group << 8) + low.bit_length() - 1
        waiting = self.buckets.pop(rank)
        if len(waiting) > 1:
            waiting.sort()
        return rank, waiting


class Encoder:
    """Ids of texts under a rank file, and bytes of ids."""

    def __init__(self, path: str = RANKS):
        self.ranks = pretokens.ranks_of(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.memo: dict[str, bytes] = {}

    def pieces(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of several pre-tokens, which share one list and one queue; a
        barrier before, between and after them belongs to no part."""
        ranks = self.ranks
        get, queue = ranks.get, RankQueue()
        push, buckets = queue.push, queue.buckets
        raw = b"\0" + b"\0".join(words) + b"\0"
        n = len(raw)
        # end[i] is where the part that starts at i ends, 0 at a barrier and once the
        # part was merged away; back[i] is where the part before it starts.
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        at, begins = 0, []
        for word in words:
            end[at] = 0
            begins.append(at + 1)
            for i in range(at + 1, at + len(word)):
                rank = get(raw[i : i + 2])
                if rank is not None:
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        push(rank, i)
            at += len(word) + 1
        end[at] = 0
        while queue.top:
            rank, waiting = queue.pop()
            for k, i in enumerate(waiting):
                middle = end[i]
                if not middle:
                    continue
                stop = end[middle]
                if not stop or get(raw[i:stop]) != rank:
                    continue
                end[i], end[middle] = stop, 0
                lowest = rank
                after = end[stop]
                if after:
                    back[stop] = i
                    new = get(raw[i:after])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            push(new, i)
                        if new < lowest:
                            lowest = new
                before = back[i]
                if end[before]:
                    new = get(raw[before:stop])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(before)
                        else:
                            push(new, before)
                        if new < lowest:
                            lowest = new
                if lowest < rank and k + 1 < len(waiting):
                    # A lower rank goes first; the rest of this bucket waits again.
                    push(rank, waiting[k + 1])
                    buckets[rank].extend(waiting[k + 2 :])
                    break
        out = []
        for i in begins:
            ids = []
            while stop := end[i]:
                ids.append(ranks[raw[i:stop]])
                i = stop
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [pretokens.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, ranks, rare = self.memo, self.ranks, {}
        new = []
        for word in set().union(*split).difference(memo):
            raw = word.encode()
            rank = ranks.get(raw)
            if rank is None:
                new.append((word, raw))
            else:
                memo[word] = pack("<I", rank)
        for (word, raw), ids in zip(new, self.pieces([raw for _, raw in new])):
            (memo if len(raw) <= MEMO_BYTES else rare)[word] = pack(f"<{len(ids)}I", *ids)
        if rare:
            return [b"".join([rare.get(w) or memo[w] for w in words]) for words in split]
        return [b"".join(map(memo.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process; its memory of pre-tokens serves all its tasks."""
    made = Encoder(path)
    common.collect_rarely()
    return made


def encode_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``(id, ids)`` per row; ids is binary, four little-endian bytes an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            for part in _parts(batch):
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {texts.schema[id_col].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``(id, ids, decoded)`` per row of ``encode_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            raw = [codec.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    source = encoded.select("id", "ids")
    return source.mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, ids binary, decoded binary")


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A few hundred rows at a time: ids take more room than the text."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def round_trip(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row: ``encode_texts``,
    ``decode_ids`` and ``digests`` in one worker, which then passes on digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for part in _parts(batch, 200):
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names,
                )

    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(decoded: DataFrame) -> DataFrame:
    """Token count and digests of what ``decode_ids`` returns."""
    return decoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return round_trip(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


