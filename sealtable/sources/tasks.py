"""How many tasks read and write a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def gathered(scan: DataFrame, wanted: int | None) -> DataFrame:
    """A scan brought to ``wanted`` partitions: merged when there are more, spread when there are fewer."""
    if wanted is None:
        return scan
    have = scan.rdd.getNumPartitions()
    if wanted == have:
        return scan
    return scan.coalesce(wanted) if wanted < have else scan.repartition(wanted)


def dealt(scan: DataFrame, wanted: int | None) -> DataFrame:
    """A scan of sealed blocks brought to ``wanted`` partitions of nearly as many blocks each.

    Merging whole splits of files gives some tasks one split more than others, which is twice
    the bytes when there are few splits a task; so blocks are exchanged, as ciphertext.
    """
    if wanted is None or wanted == scan.rdd.getNumPartitions():
        return scan
    return scan.repartition(wanted)


def spread(df: DataFrame, wanted: int | None, have: int | None = None) -> DataFrame:
    """Bring ``df`` to ``wanted`` partitions at write time.

    Merging a few neighbours needs no shuffle.  Merging many would leave the
    upstream work to a handful of tasks, so then the rows are exchanged instead.
    """
    if wanted is None or wanted == have:
        return df
    if have is not None and have // 4 <= wanted < have:
        return df.coalesce(wanted)
    return df.repartition(wanted)
