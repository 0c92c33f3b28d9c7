"""Skipping blocks of a columnar table without opening them.

An index is a table of its own: for a block and a column, the least and greatest value as a
small ciphertext, and a Bloom filter whose bits come from keyed digests (HMAC) of the
values.  Nothing in it is plain, and without the key nobody can ask it.  It is made from the
written table, opens only the indexed columns, adds only the blocks that it does not have,
and may be made at any time; blocks that it lacks are read.

Both answers err on one side only: a block that is skipped has no matching row, a block that
is read may have none.  What can be seen: which blocks and column numbers are indexed, and
from a filter's length about how many different values a block has.
"""

from __future__ import annotations

import hashlib
import hmac
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions import payload
from sealtable.functions.cipher import seal, unseal
from sealtable.operators.keyring import Keyring
from sealtable.session import work_path
from sealtable.sources.columns import body_name, decoded, open_columns, opened_bodies, positions_of, scan_columns

INDEX_SCHEMA = "block string, key_id int, position int, bounds binary, bloom binary"

# Ten bits a value and seven probes let about one block in a hundred through by chance.
BITS_PER_VALUE, PROBES = 10, 7
# Longer strings are cut in the bounds, the upper one then stands for all that begin like it.
BOUND_CHARS = 64
# Up to so many blocks that stay, a scan is told their names and files.
LISTED_BLOCKS = 10_000


@dataclass(frozen=True)
class Equal:
    """Rows whose column has a value; null matches nothing."""

    column: str
    value: Any

    def rows(self) -> Column:
        return payload.column(self.column) == F.lit(self.value)


@dataclass(frozen=True)
class Between:
    """Rows whose column lies between two values, both included; None is no bound."""

    column: str
    low: Any = None
    high: Any = None

    def rows(self) -> Column:
        column = payload.column(self.column)
        kept = column.isNotNull()
        if self.low is not None:
            kept = kept & (column >= F.lit(self.low))
        return kept if self.high is None else kept & (column <= F.lit(self.high))


def _index_key() -> Column:
    """A key for the index alone, derived from the data key."""
    return F.unhex(F.sha2(F.concat(F.lit("sealtable block index").cast("binary"), F.col("data_key")), 256))


def _plain(value: Any) -> Any:
    """One form for values that are equal in SQL."""
    return value + 0.0 if isinstance(value, float) else value


def _probes(key: bytes, position: int, value: Any, bits: int) -> Iterator[int]:
    digest = hmac.digest(key, f"{position}:{_plain(value)!r}".encode(), hashlib.sha256)
    first, step = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:16], "little") | 1
    return ((first + k * step) % bits for k in range(PROBES))


def _bloom(key: bytes, position: int, values: Sequence) -> bytes:
    bits = 1 << max(6, math.ceil(math.log2(max(1, len(values)) * BITS_PER_VALUE)))
    filter_ = bytearray(bits // 8)
    for value in values:
        for at in _probes(key, position, value, bits):
            filter_[at >> 3] |= 1 << (at & 7)
    return bytes(filter_)


def _may_hold(bloom: bytes, key: bytes, position: int, value: Any) -> bool:
    return all(bloom[at >> 3] >> (at & 7) & 1 for at in _probes(key, position, value, 8 * len(bloom)))


def _bounds(values) -> bytes:
    """Least and greatest of the distinct values as an Arrow stream of 0 or 2 rows, behind a
    byte that says whether there is no upper bound: a float that is no number sorts above all."""
    import pyarrow as pa

    known = [v for v in values.to_pylist() if v is not None]
    open_above = any(v != v for v in known)
    known = [v for v in known if v == v]
    if pa.types.is_string(values.type) and known:
        known = [min(known)[:BOUND_CHARS], max(known)[:BOUND_CHARS]]
    batch = pa.record_batch([pa.array([min(known), max(known)] if known else [], values.type)], ["v"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return bytes([open_above]) + sink.getvalue().to_pybytes()


def _read_bounds(raw: bytes):
    """``(ends, open above, type)``."""
    import pyarrow as pa

    with pa.ipc.open_stream(pa.BufferReader(raw[1:])) as stream:
        table = stream.read_all()
    return table.column("v").to_pylist(), bool(raw[0]), table.schema.field("v").type


def _indexable(field: T.StructField) -> None:
    flat = (
        T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType,
        T.DateType, T.TimestampNTZType, T.TimestampType, T.StringType,
    )
    if not isinstance(field.dataType, flat):
        raise ValueError(f"column {field.name} of type {field.dataType.simpleString()} cannot be indexed")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(index)


def build_index(
    spark: SparkSession, path: str, index: str, keyring: Keyring, schema: T.StructType | str, columns: Sequence[str]
) -> None:
    """Index these columns of all blocks that the index does not have yet."""
    schema = payload.as_schema(schema)
    positions = positions_of(schema, columns)
    for k in positions:
        _indexable(schema[k])
    # An empty write gives the folder a schema, so that a first index is like any other.
    spark.createDataFrame([], INDEX_SCHEMA).write.mode("append").parquet(index)

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["block", "key_id", "position", "bounds", "bloom"]
        for batch in batches:
            for row in range(batch.num_rows):
                block, key_id, key, n, position, body = (batch.column(c)[row] for c in range(6))
                distinct = pc.unique(decoded(body, n.as_py()))
                k, at = key.as_py(), position.as_py()
                known = [v for v in distinct.to_pylist() if v is not None]
                values = [[block.as_py()], [key_id.as_py()], [at], [_bounds(distinct)], [_bloom(k, at, known)]]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

    parts = []
    for k in positions:
        had = read_index(spark, index).where(F.col("position") == k).select("block")
        missing = scan_columns(spark, path, [k]).join(had, "block", "left_anti")
        bodies = opened_bodies(missing, keyring, schema, [k], "block", "key_id", _index_key().alias("index_key"))
        parts.append(bodies.select("block", "key_id", "index_key", "n_rows", F.lit(k).alias("position"), body_name(k)))
    rows = reduce(DataFrame.unionByName, [p.withColumnRenamed(p.columns[-1], "body") for p in parts])
    described = keyring.attach(rows.mapInArrow(describe, INDEX_SCHEMA))
    sealed = described.withColumn("bounds", seal(F.col("bounds"), F.col("data_key"))).drop("data_key")
    sealed.select("block", "key_id", "position", "bounds", "bloom").write.mode("append").parquet(index)


def _keeps(test: Equal | Between, ends, open_above: bool, kind, bloom: bytes, key: bytes, position: int) -> bool:
    """Whether a block may hold a row of the test; values of another type skip nothing."""
    import pyarrow as pa

    try:
        return _may_match(test, ends, open_above, kind, bloom, key, position)
    except (TypeError, pa.ArrowException):
        return True


def _may_match(test: Equal | Between, ends, open_above: bool, kind, bloom: bytes, key: bytes, position: int) -> bool:
    import pyarrow as pa

    def typed(value: Any) -> Any:
        return None if value is None else pa.scalar(value, kind).as_py()

    if isinstance(test, Equal):
        if test.value is None:
            return False
        value = _plain(typed(test.value))
        if not _may_hold(bloom, key, position, value):
            return False
        low = high = value
    else:
        low, high = typed(test.low), typed(test.high)
    if not ends:
        return open_above
    least, most = ends
    if pa.types.is_string(kind):
        low, high = (None if x is None else x[:BOUND_CHARS] for x in (low, high))
    # Not-a-number is above every number and equal to itself.
    if high is not None and high == high and least > high:
        return False
    return low is None or open_above or (low == low and most >= low)


def skipped_blocks(
    spark: SparkSession, index: str, keyring: Keyring, schema: T.StructType | str, tests: Sequence[Equal | Between]
) -> DataFrame:
    """``(block)``: the blocks that cannot hold a row of all tests, by their index alone."""
    schema = payload.as_schema(schema)
    by_position: dict[int, list[Equal | Between]] = {}
    for test in tests:
        by_position.setdefault(positions_of(schema, [test.column])[0], []).append(test)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            gone = []
            for row in batch.to_pylist():
                ends, open_above, kind = _read_bounds(row["bounds"])
                at = row["position"]
                if not all(_keeps(t, ends, open_above, kind, row["bloom"], row["index_key"], at) for t in by_position[at]):
                    gone.append(row["block"])
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["block"])

    rows = keyring.attach(read_index(spark, index).where(F.col("position").isin(list(by_position))))
    opened = rows.select("block", "position", unseal(F.col("bounds"), F.col("data_key")).alias("bounds"), "bloom", _index_key().alias("index_key"))
    return opened.mapInArrow(judge, "block string").distinct()


def kept_blocks(
    spark: SparkSession, path: str, index: str, keyring: Keyring, schema: T.StructType | str, tests: Sequence[Equal | Between]
) -> DataFrame:
    """``(block, file)`` of the blocks that have to be opened; no body is read for it."""
    named = scan_columns(spark, path, []).select("block", F.col("_metadata.file_path").alias("file"))
    return named.join(skipped_blocks(spark, index, keyring, schema, tests), "block", "left_anti")


def read_where(
    spark: SparkSession,
    path: str,
    index: str,
    keyring: Keyring,
    schema: T.StructType | str,
    tests: Sequence[Equal | Between],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows that pass all tests, from the blocks that may hold some.

    The names of blocks that stay are written down once.  If they are few, only their files
    are opened and the scan gets their names as a filter; else they are joined.
    """
    schema = payload.as_schema(schema)
    if not tests:
        raise ValueError("nothing to test; read the table as a whole")
    columns = schema.names if columns is None else list(columns)
    needed = list(dict.fromkeys([*columns, *[t.column for t in tests]]))
    positions = positions_of(schema, needed)
    noted = work_path(spark, "kept")
    kept_blocks(spark, path, index, keyring, schema, tests).write.parquet(noted)
    kept = spark.read.schema("block string, file string").parquet(noted)
    few = kept.limit(LISTED_BLOCKS + 1).collect()
    if len(few) <= LISTED_BLOCKS:
        files = sorted({r.file for r in few}) or path
        scan = scan_columns(spark, files, positions).where(F.col("block").isin(sorted(r.block for r in few)))
    else:
        scan = scan_columns(spark, path, positions).join(kept.select("block"), "block", "left_semi")
    rows = open_columns(scan, keyring, schema, needed).where(reduce(Column.__and__, [t.rows() for t in tests]))
    return rows.select(*[payload.column(c) for c in columns])
