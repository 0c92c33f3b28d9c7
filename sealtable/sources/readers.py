"""Sources: encrypted tables in four layouts and plain CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions import payload
from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT, unseal_marked, unseal_text
from sealtable.operators.keyring import Keyring
from sealtable.sources.blocks import unpack_lines
from sealtable.sources.columns import open_columns, positions_of, scan_columns
from sealtable.sources.files import find_files, open_files, read_files  # noqa: F401
from sealtable.sources.tasks import dealt, gathered


def scan_sealed(
    spark: SparkSession, path: str, layout: str = "line", partitions: int | None = None, glob: str | None = None
) -> DataFrame:
    """Ciphertext rows ``(key_id, body)``; plain files in the same folder are not picked up."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if layout == "parquet":
        found = reader.option("pathGlobFilter", glob or "*.parquet").schema("key_id int, body binary").parquet(path)
        return dealt(found, partitions)
    if layout != "line":
        raise ValueError(f"unknown layout {layout!r}")
    # Dealt as bytes, which are a quarter less than their base64.
    sealed = reader.option("pathGlobFilter", glob or "*.txt").text(path).select(
        F.substring_index("value", " ", 1).try_cast("int").alias("key_id"),
        F.unbase64(F.substring_index("value", " ", -1)).alias("body"),
    )
    return dealt(sealed, partitions)


def open_sealed(
    sealed: DataFrame,
    keyring: Keyring,
    schema: T.StructType | str,
    fmt: str | None = None,
    codec: str | None = None,
) -> DataFrame:
    """Decrypt ``(key_id, body)`` rows into a table.

    Each block is decrypted once, below a generator or a map that nothing above it can
    copy or enter.
    """
    schema = payload.as_schema(schema)
    fmt = fmt or payload.pick_format(schema)
    keyed, body, key = keyring.attach(sealed), F.col("body"), F.col("data_key")
    mark = payload.schema_mark(schema, fmt)
    if codec is None:
        lines = keyed.select(F.explode(F.split(unseal_text(body, key, mark), "\n")).alias("line"))
    else:
        lines = unpack_lines(keyed.select(unseal_marked(body, key, mark).alias("block")), codec)
    return payload.decode(lines, schema, fmt)


def read_plain(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    partitions: int | None = None,
    multi_line: bool = False,
    glob: str | None = "*.csv",
) -> DataFrame:
    """CSV with a header.  ``multi_line`` admits line breaks inside quotes but makes a file one task."""
    reader = spark.read.schema(payload.as_schema(schema)).options(**payload.CSV_FILE)
    reader = reader.options(enforceSchema="false", mode="FAILFAST", multiLine=str(multi_line).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return gathered(reader.csv(path), partitions)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    keyring: Keyring | None = None,
    crypto_mode: str = AES_CBC,
    layout: str = "line",
    fmt: str | None = None,
    partitions: int | None = None,
    codec: str | None = None,
    multi_line: bool = False,
    columns: Sequence[str] | None = None,
    key_id: int | None = None,
) -> DataFrame:
    """Read an encrypted or a plain table, whichever ``crypto_mode`` says.  With ``columns``
    only these are returned; the ``columns`` layout then opens nothing else.  ``key_id`` is the
    key of files in the ``file`` layout that do not name theirs."""
    if columns is not None and not (layout == "columns" and crypto_mode == AES_CBC):
        whole = read_table(
            spark, path, schema, keyring, crypto_mode, layout, fmt, partitions, codec, multi_line, key_id=key_id
        )
        return whole.select(*[payload.column(c) for c in columns])
    if crypto_mode == PLAIN_TEXT:
        return read_plain(spark, path, schema, partitions, multi_line)
    if crypto_mode != AES_CBC:
        raise ValueError(f"unknown crypto mode {crypto_mode!r}")
    if keyring is None:
        raise ValueError("an encrypted table needs a keyring")
    if layout == "columns":
        schema = payload.as_schema(schema)
        columns = schema.names if columns is None else list(columns)
        scan = gathered(scan_columns(spark, path, positions_of(schema, columns)), partitions)
        return open_columns(scan, keyring, schema, columns)
    if layout == "file":
        return read_files(spark, path, keyring, schema, key_id, partitions)
    return open_sealed(scan_sealed(spark, path, layout, partitions), keyring, schema, fmt, codec)
