"""Operator 10: best-fit packing of token pieces by rounds over a tree of nodes.

Texts become pieces of at most ``capacity`` tokens; only longer documents are cut, and
then only the first piece may be shorter.  A full piece is a sequence by itself.  The
others are dealt round-robin to nodes of about ``node_rows`` pieces.  Each node packs its
pieces by best fit, longest first, emits the bins that are nearly full, and passes on at
most ``carry`` of its emptiest bins, each as one item; the rest is emitted as it is.  In
the next round a node takes what ``fan_in`` nodes passed on and packs these items again,
until one node is left.  So every node holds a bounded number of rows at any size.

A bin's free room is looked up in a bitmap over the possible rooms: the smallest room
that holds an item is one find-first-set step.

Defined cases: a null or empty text is its final id alone; repeated rows and ids each
give their own pieces; other columns are never read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common, library

CAPACITY = 2048
NODE_ROWS, FAN_IN, CARRY, NEARLY = 8192, 8, 512, 16


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = library.RANKS,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, the ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library.token_ids(path, 4)
        final = pack("<I", end_id)
        for whole in batches:
            for row in range(0, whole.num_rows, 1000):
                batch = whole.slice(row, 1000)
                of, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = memoryview(codec.encode(text or "") + final)
                    n = len(ids) // 4
                    a, number = 0, 0
                    b = n % capacity or capacity
                    while a < n:
                        of.append(k)
                        piece.append(number)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                        if with_ids:
                            kept.append(bytes(ids[4 * a : 4 * b]))
                        a, b, number = b, b + capacity, number + 1
                columns = [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, longest first, and how full each bin is."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    rooms: dict[int, list[int]] = {}
    free = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[k], places[k] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            rooms.setdefault(left, []).append(chosen)
            free |= 1 << left
    return bins, places, np.array(fills, np.int64)


def _round(rows: pd.DataFrame, level: int, capacity: int, carry: int, nearly: int, last: bool) -> pd.DataFrame:
    """Packs the items of one node; an item is a bin of the round before."""
    rows = rows.sort_values(["bin", "place"], kind="stable")
    item, first = np.unique(rows["bin"].to_numpy(), return_inverse=True)
    sizes = np.bincount(first, weights=rows["length"].to_numpy(), minlength=len(item)).astype(np.int64)
    bins, places, fills = best_fit(sizes, capacity)
    done = capacity - fills <= nearly
    # Of the others the emptiest go on.
    order = np.argsort(fills, kind="stable")
    going = order[~done[order]][:carry]
    done[:] = True
    done[going] = last
    node = int(rows["node"].iloc[0])
    rows["place"] = rows["place"].to_numpy() + places[first]
    rows["bin"] = (level << 58) + (node << 24) + bins[first]
    rows["done"] = done[bins[first]]
    return rows


def pack_pieces(
    cut: DataFrame,
    capacity: int = CAPACITY,
    node_rows: int = NODE_ROWS,
    fan_in: int = FAN_IN,
    carry: int = CARRY,
    nearly: int = NEARLY,
) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    names = list(cut.columns)
    cut = common.stored(cut, "pieces")
    # Numbers follow the stored files, so every run over them deals alike.
    cut = cut.withColumn("uid", F.monotonically_increasing_id())
    full = cut.where(F.col("length") == capacity)
    rest = cut.where(F.col("length") < capacity)
    nodes = max(1, -(-rest.count() // node_rows))
    out = [full.select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    schema = f"{_ddl(cut, names)}, bin long, place long, node long, done boolean"
    items = rest.select(
        *names,
        F.col("uid").alias("bin"),
        F.lit(0).cast("long").alias("place"),
        F.pmod(F.xxhash64("uid"), F.lit(nodes)).alias("node"),
    )
    level = 0
    while True:
        last = nodes == 1

        packed = _rounds(level, capacity, carry, nearly, last)
        # As many tasks as nodes, whatever a small row count suggests.
        dealt = items.repartition(nodes, "node") if nodes > 1 else items
        done = common.stored(dealt.groupBy("node").applyInPandas(packed, schema), "packed")
        out.append(
            done.where("done").select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
        )
        if last:
            break
        nodes = -(-nodes // fan_in)
        level += 1
        items = done.where("not done").select(
            *names, "bin", "place", F.floor(F.col("node") / fan_in).cast("long").alias("node")
        )
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _rounds(*how):
    """One round's function of the rows of a node."""
    return lambda rows: _round(rows, *how)


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """Pieces of all documents with the sequence and the place each one has."""
    return pack_pieces(pieces(docs, capacity, **how), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
