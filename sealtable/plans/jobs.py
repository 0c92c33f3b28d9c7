"""Whole-table jobs: encrypt, decrypt, change mode, change key, query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT, seal, unseal
from sealtable.operators.keyring import Keyring
from sealtable.operators.relational import young_developers
from sealtable.operators.skipping import Between, Equal, read_where
from sealtable.sources.columns import rekeyed_columns, scan_columns, write_blocks
from sealtable.sources.files import rekey_files
from sealtable.sources.readers import read_table, scan_sealed
from sealtable.sources.tasks import spread
from sealtable.sources.writers import write_sealed, write_table


def transcode(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType | str,
    input_mode: str,
    output_mode: str,
    keyring: Keyring | None = None,
    input_partitions: int | None = None,
    output_partitions: int | None = None,
    input_layout: str = "line",
    output_layout: str = "line",
    fmt: str | None = None,
    save_mode: str = "errorifexists",
    keep: Column | None = None,
    codec: str | None = None,
    multi_line: bool = False,
    columns: Sequence[str] | None = None,
    index: str | None = None,
    tests: Sequence[Equal | Between] = (),
) -> None:
    """Read a table in one crypto mode and write it in another, optionally keeping only some
    rows and columns.  With an ``index`` of a table in the ``columns`` layout, blocks that
    cannot hold a row of ``tests`` are not opened."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("input and output must be different folders")
    if index is not None:
        if (input_mode, input_layout) != (AES_CBC, "columns") or keyring is None:
            raise ValueError("only an encrypted table in the columns layout has an index")
        table = read_where(spark, source, index, keyring, schema, tests, columns)
    else:
        table = read_table(
            spark, source, schema, keyring, input_mode, input_layout, fmt, input_partitions, codec, multi_line, columns
        )
        for test in tests:
            table = table.where(test.rows())
    if keep is not None:
        table = table.where(keep)
    write_table(
        table, target, keyring, output_mode, output_layout, fmt, output_partitions, input_partitions, save_mode,
        codec=codec, multi_line=multi_line,
    )


def encrypt_table(
    spark: SparkSession, source: str, target: str, schema: T.StructType | str, keyring: Keyring, **options
) -> None:
    """Plain CSV with header to ciphertext."""
    transcode(spark, source, target, schema, PLAIN_TEXT, AES_CBC, keyring, **options)


def decrypt_table(
    spark: SparkSession, source: str, target: str, schema: T.StructType | str, keyring: Keyring, **options
) -> None:
    """Ciphertext to plain CSV with header."""
    transcode(spark, source, target, schema, AES_CBC, PLAIN_TEXT, keyring, **options)


def query_table(
    spark: SparkSession,
    source: str,
    target: str,
    keyring: Keyring,
    schema: T.StructType | str,
    keep: Column | None = None,
    **options,
) -> None:
    """Encrypted table in, filtered rows out, encrypted again."""
    if keep is None and not options.get("tests"):
        keep = young_developers()
    transcode(spark, source, target, schema, AES_CBC, AES_CBC, keyring, keep=keep, **options)


def rekeyed(sealed: DataFrame, keyring: Keyring) -> DataFrame:
    """Ciphertext rows under older keys, encrypted anew under the active key.

    Blocks are not taken apart: what is inside stays packed, compressed or not.  Blocks that already
    use the active key pass through, so a rotation can be repeated or resumed.
    """
    stale = F.coalesce(F.col("key_id") != keyring.active_id, F.lit(True))
    opened = keyring.attach(sealed).select(
        "body", F.when(stale, unseal(F.col("body"), F.col("data_key"))).alias("block")
    )
    anew = seal(F.col("block"), keyring.active_key())
    return opened.select(
        F.lit(keyring.active_id).alias("key_id"),
        F.when(F.col("block").isNotNull(), anew).otherwise(F.col("body")).alias("body"),
    )


def rekey_table(
    spark: SparkSession,
    source: str,
    target: str,
    keyring: Keyring,
    layout: str = "line",
    partitions: int | None = None,
    save_mode: str = "errorifexists",
) -> None:
    """Rotate a table to the active key, block by block and without a shuffle; the ``file``
    layout file by file, and a target that holds some of the files gets the others."""
    if layout == "file":
        rekey_files(spark, source, target, keyring, partitions=partitions)
        return
    if layout == "columns":
        bodies = sum(c.startswith("c") for c in spark.read.parquet(source).columns)
        moved = rekeyed_columns(scan_columns(spark, source, range(bodies)), keyring)
        write_blocks(spread(moved, partitions), target, save_mode)
        return
    moved = rekeyed(scan_sealed(spark, source, layout), keyring)
    write_sealed(spread(moved, partitions), target, layout, save_mode)
