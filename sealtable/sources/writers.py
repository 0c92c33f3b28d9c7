"""Sinks: encrypted tables in three layouts, plain CSV, archives and run logs.

Layouts of an encrypted table:

``line``     text rows ``<key_id> <base64(IV || CBC(check || schema mark || block))>``
``parquet``  the same without base64: columns ``key_id``, ``body``
``columns``  one row per block with a ciphertext for each column, so that a reader opens few
``file``     whole CSV files with header, one ciphertext each, for exchange

A block holds many rows.  All layouts are written without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtable.functions import payload
from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT, marked, no_newlines, seal
from sealtable.operators.keyring import Keyring
from sealtable.sources.blocks import BLOCK_BYTES, pack_lines
from sealtable.sources.columns import clustered, seal_columns, write_blocks
from sealtable.sources.files import export_files, seal_files, write_files  # noqa: F401
from sealtable.sources.tasks import spread

# Rows of a plain file whose values may have line breaks.
MULTI_LINE_ROWS = 100_000


def seal_rows(
    df: DataFrame,
    keyring: Keyring,
    fmt: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    codec: str | None = None,
) -> DataFrame:
    """Any table as encrypted blocks ``(key_id, body)`` under the active key."""
    fmt = fmt or payload.pick_format(df.schema)
    blocks = pack_lines(payload.encode(df, fmt), block_bytes, codec)
    mark = payload.schema_mark(df.schema, fmt)
    return seal_blocks(blocks.select(marked(F.col("block"), mark).alias("block")), keyring)


def seal_blocks(blocks: DataFrame, keyring: Keyring) -> DataFrame:
    return blocks.select(
        F.lit(keyring.active_id).alias("key_id"), seal(F.col("block"), keyring.active_key()).alias("body")
    )


def as_lines(sealed: DataFrame) -> DataFrame:
    """``(key_id, body)`` as single text rows."""
    return sealed.select(
        F.concat_ws(" ", F.col("key_id").cast("string"), no_newlines(F.base64("body"))).alias("value")
    )


def write_table(
    df: DataFrame,
    path: str,
    keyring: Keyring | None = None,
    crypto_mode: str = AES_CBC,
    layout: str = "line",
    fmt: str | None = None,
    partitions: int | None = None,
    have_partitions: int | None = None,
    save_mode: str = "errorifexists",
    block_bytes: int = BLOCK_BYTES,
    codec: str | None = None,
    multi_line: bool = False,
    cluster_by: Sequence[str] = (),
    block_rows: int | None = None,
) -> None:
    """Write ``df`` encrypted or plain, in ``partitions`` files when that is given.  With
    ``cluster_by`` rows are first sorted by ranges of these columns."""
    if cluster_by:
        df = clustered(df, cluster_by)
    if crypto_mode == PLAIN_TEXT:
        write_plain(df, path, partitions, have_partitions, save_mode, multi_line)
        return
    if crypto_mode != AES_CBC:
        raise ValueError(f"unknown crypto mode {crypto_mode!r}")
    if keyring is None:
        raise ValueError("an encrypted table needs a keyring")
    if layout == "file":
        write_files(spread(df, partitions, have_partitions), path, keyring, save_mode)
        return
    # Only ciphertext is exchanged when the number of files is fixed.
    if layout == "columns":
        sealed = seal_columns(df, keyring, **({"block_rows": block_rows} if block_rows else {}), codec=codec)
        write_blocks(spread(sealed, partitions, have_partitions), path, save_mode)
        return
    sealed = seal_rows(df, keyring, fmt, block_bytes, codec)
    write_sealed(spread(sealed, partitions, have_partitions), path, layout, save_mode)


def write_sealed(sealed: DataFrame, path: str, layout: str = "line", save_mode: str = "errorifexists") -> None:
    if layout == "line":
        as_lines(sealed).write.mode(save_mode).text(path)
    elif layout == "parquet":
        # Ciphertext neither compresses nor repeats.
        sealed.write.mode(save_mode).option("compression", "none").option("parquet.enable.dictionary", "false").parquet(
            path
        )
    else:
        raise ValueError(f"unknown layout {layout!r}")


def write_plain(
    df: DataFrame,
    path: str,
    partitions: int | None = None,
    have_partitions: int | None = None,
    save_mode: str = "errorifexists",
    multi_line: bool = False,
) -> None:
    """CSV with a header.  Strings with line breaks are refused unless ``multi_line`` is
    set, and then files hold a bounded number of rows, as each is read by one task."""
    rows = spread(payload.plain_strings(df, multi_line), partitions, have_partitions)
    writer = rows.write.mode(save_mode).options(**payload.CSV_FILE)
    if multi_line:
        writer = writer.option("maxRecordsPerFile", MULTI_LINE_ROWS)
    writer.csv(path)
