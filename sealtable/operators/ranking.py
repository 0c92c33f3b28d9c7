"""Row numbers over groups of any size.

``row_number()`` sends a whole group to one task.  Here the rows are range
partitioned by group and order, so a group of any size spreads over as many tasks
as it needs; only one count per (group, partition) is summed up in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealtable.session import held


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Add the 1-based place of each row within its group.

    Rows equal in all ``order`` columns get places in no particular order; a running
    id lets even these spread over partitions, so copies of one row may be many.

    The ordered rows are read twice, and range bounds are sampled anew on each
    evaluation.  They are therefore persisted on the executors' disks, where Spark
    encrypts them like its shuffle files, and made again from the same shuffle if an
    executor is lost.  No job runs while the plan is built.
    """
    keys = [*group, *order, "_tie"]
    stored = held(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*df.columns, F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().alias("_seq"))
    )
    slices = stored.groupBy(*group, "_slice").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_slice").alias("_s"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    if not group:
        offsets = F.broadcast(offsets)  # one row per task
    same = [stored["_slice"] == offsets["_s"]]
    same += [stored[c].eqNullSafe(offsets[f"_g{i}"]) for i, c in enumerate(group)]
    numbered = stored.join(offsets, reduce(lambda a, b: a & b, same))
    place = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    return numbered.select(*df.columns, place.alias(name))
