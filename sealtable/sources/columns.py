"""Columnar ciphertext: every column of a block of rows is a ciphertext of its own.

A block is one row of a Parquet table: ``key_id``, ``block`` (a name no other block has),
``n_rows``, and one body ``c0, c1, ...`` per column.  A body holds the column's values as an
Arrow stream, typed, so nothing is printed as text and parsed again.  A reader that is told
the columns it wants scans, decrypts and decodes only their bodies.

Each body is bound to the name and type of its column, like blocks of the other layouts.
Names of columns are not stored; how many rows a block has and how long its bodies are can
be seen.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions import payload
from sealtable.functions.cipher import marked, seal, unseal, unseal_marked
from sealtable.operators.keyring import Keyring

# A block is closed when it has so many rows, or so many bytes in Arrow's form.
BLOCK_ROWS = 65_536
BLOCK_BYTES = 4 * 1024 * 1024

# One block may be megabytes: Parquet must look at its sizes after every row, and puts each
# body on a page of its own, which a filter on ``block`` can skip.
PARQUET = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.page.size": "65536",
}


def body_name(position: int) -> str:
    return f"c{position}"


def sealed_schema(positions: Sequence[int]) -> str:
    bodies = "".join(f", {body_name(k)} binary" for k in positions)
    return f"key_id int, block string, n_rows int{bodies}"


def _mark(field: T.StructField) -> bytes:
    return payload.schema_mark(T.StructType([field]), "arrow")


def pack_columns(
    df: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, codec: str | None = None
) -> DataFrame:
    """``(n_rows, c0, c1, ...)``: neighbouring rows of a task as blocks, whatever batches they
    come in.  Bodies are Arrow streams, compressed if ``codec`` is ``zstd``."""
    if codec not in (None, "zstd"):
        raise ValueError(f"unknown codec {codec!r}")
    names = [body_name(k) for k in range(len(df.columns))]

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        options = pa.ipc.IpcWriteOptions(compression=codec)
        held: list[pa.RecordBatch] = []

        def body(column: pa.ChunkedArray) -> bytes:
            sink = pa.BufferOutputStream()
            whole = pa.record_batch([column.combine_chunks()], ["v"])
            with pa.ipc.new_stream(sink, whole.schema, options=options) as stream:
                stream.write_batch(whole)
            return sink.getvalue().to_pybytes()

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            bodies = [pa.array([body(c)], pa.binary()) for c in rows.columns]
            return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int32()), *bodies], ["n_rows", *names])

        rows = size = 0
        for batch in batches:
            a_row, at = max(1, batch.nbytes // max(1, batch.num_rows)), 0
            while at < batch.num_rows:
                part = batch.slice(at, max(1, min(block_rows - rows, (block_bytes - size) // a_row)))
                at += part.num_rows
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows >= block_rows or size >= block_bytes:
                    yield block()
                    rows = size = 0
        if held:
            yield block()

    return df.mapInArrow(pack, "n_rows int, " + ", ".join(f"{n} binary" for n in names))


def seal_columns(
    df: DataFrame,
    keyring: Keyring,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
    codec: str | None = None,
) -> DataFrame:
    """Any table as blocks with one body per column, under the active key; no shuffle."""
    if not df.columns:
        raise ValueError("a table without columns has no bodies")
    key, write = keyring.active_key(), secrets.token_hex(8)
    bodies = [
        seal(marked(F.col(body_name(k)), _mark(f)), key).alias(body_name(k)) for k, f in enumerate(df.schema)
    ]
    name = F.format_string(f"{write}-%016x", F.monotonically_increasing_id())
    packed = pack_columns(df, block_rows, block_bytes, codec)
    return packed.select(F.lit(keyring.active_id).alias("key_id"), name.alias("block"), "n_rows", *bodies)


def clustered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``by``, so that blocks hold neighbours and an index can skip most."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def write_blocks(sealed: DataFrame, path: str, save_mode: str = "errorifexists") -> None:
    sealed.write.mode(save_mode).options(**PARQUET).parquet(path)


def scan_columns(spark: SparkSession, path: str | Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Blocks with the bodies of these columns only; the others are not read."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.schema(sealed_schema(positions)).parquet(*([path] if isinstance(path, str) else path))


def positions_of(schema: T.StructType, columns: Sequence[str]) -> list[int]:
    unknown = [c for c in columns if c not in schema.names]
    if unknown or len(set(columns)) < len(columns):
        raise ValueError(f"not columns of this table, or named twice: {unknown or list(columns)}")
    return [schema.names.index(c) for c in columns]


def opened_bodies(sealed: DataFrame, keyring: Keyring, schema: T.StructType, positions: Sequence[int], *keep) -> DataFrame:
    """The bodies decrypted but not decoded, beside ``n_rows`` and the columns of ``keep``."""
    key = F.col("data_key")
    plain = [unseal_marked(F.col(body_name(k)), key, _mark(schema[k])).alias(body_name(k)) for k in positions]
    return keyring.attach(sealed).select(*keep, "n_rows", *plain)


def decoded(body, n_rows: int):
    """The values of one body; another number of them than the block has rows is an error."""
    import pyarrow as pa

    with pa.ipc.open_stream(pa.BufferReader(body.as_buffer())) as stream:
        values = stream.read_all().column(0).combine_chunks()
    if len(values) != n_rows:
        raise ValueError(f"a body holds {len(values)} values, its block has {n_rows} rows")
    return values


def open_columns(
    sealed: DataFrame, keyring: Keyring, schema: T.StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The wanted columns of a scan as a table; each body is decrypted once."""
    schema = payload.as_schema(schema)
    columns = schema.names if columns is None else list(columns)
    if not columns:
        raise ValueError("name at least one column; count_rows counts without opening any")
    positions = positions_of(schema, columns)
    wanted = T.StructType([schema[k] for k in positions])

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column(0)[row].as_py()
                values = [decoded(batch.column(1 + k)[row], n) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays(values, columns)

    return opened_bodies(sealed, keyring, schema, positions).mapInArrow(unpack, wanted)


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """The row count ``n`` of a table; no body is read."""
    return scan_columns(spark, path, []).agg(F.coalesce(F.sum(F.col("n_rows").cast("long")), F.lit(0)).alias("n"))


def rekeyed_columns(sealed: DataFrame, keyring: Keyring) -> DataFrame:
    """Blocks under older keys, each body encrypted anew under the active one; names of blocks
    stay, so an index stays right.  Blocks that already use the active key pass through."""
    stale = F.coalesce(F.col("key_id") != keyring.active_id, F.lit(True))
    key, fresh = F.col("data_key"), keyring.active_key()
    bodies = [c for c in sealed.columns if c not in ("key_id", "block", "n_rows")]
    moved = [F.when(stale, seal(unseal(F.col(c), key), fresh)).otherwise(F.col(c)).alias(c) for c in bodies]
    return keyring.attach(sealed).select(F.lit(keyring.active_id).alias("key_id"), "block", "n_rows", *moved)
