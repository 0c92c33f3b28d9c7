"""Archiving the outputs of runs, and the run log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.functions.text import after_last, glob_match

# Fixed value: names of a run's outputs end in the run's id after the last dash.
RUN_GLOB = "*spark-application*"

LOG_SCHEMA = "app_id string, job string, started_at timestamp, finished_at timestamp, n_rows bigint"


def of_runs(df: DataFrame, path_column: str, glob: str = RUN_GLOB) -> DataFrame:
    """Rows whose path belongs to a run, with the run's id as ``app_id``."""
    path = F.col(path_column)
    return df.where(glob_match(path, glob)).withColumn("app_id", after_last(path, "-"))


def text_outputs(spark: SparkSession, folder: str, glob: str = RUN_GLOB) -> DataFrame:
    """Lines of all text files below ``folder``, with the run's file or folder name as ``entry``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    mark = glob.strip("*")
    return lines.select(
        "value",
        F.input_file_name().alias("path"),
        F.regexp_extract(F.input_file_name(), f"[^/]*\\Q{mark}\\E[^/]*", 0).alias("entry"),
    )


def archive_runs(df: DataFrame, target: str, path_column: str, glob: str = RUN_GLOB, fmt: str = "parquet") -> None:
    """Store rows under one folder per run; archiving a run again replaces only that run.

    The rebalance hint lets Spark gather small runs into few files and split a run
    that holds most of the rows over many tasks.
    """
    (
        of_runs(df, path_column, glob)
        .hint("rebalance", F.col("app_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("app_id")
        .format(fmt)
        .save(target)
    )


class _ByTask(AccumulatorParam):
    """Numbers by task; a task that runs again puts the same number in the same place."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:  # noqa: N802
        value1.update(value2)
        return value1


def counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``df``, and a function that tells how many rows of it have been read to their end.

    Each task reports its number of rows under the number of its partition.  Only tasks that
    succeed report, and one that has to run again, for a lost executor or as a copy of a slow
    one, reports the same under the same number; hence each row counts once.
    """
    found = df.sparkSession.sparkContext.accumulator({}, _ByTask())

    def run(batches: Iterator) -> Iterator:
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            yield batch
        found.add({TaskContext.get().partitionId(): rows})

    return df.mapInArrow(run, df.schema), lambda: sum(found.value.values())


def logged(spark: SparkSession, log_path: str, app_id: str, job: str, df: DataFrame, write: Callable) -> None:
    """Run ``write(df)`` and append one row about it to the run log.

    Rows are counted while they are written, without a second pass, and each once.
    """
    rows, n_rows = counted(df)
    started = dt.datetime.now(dt.UTC)
    write(rows)
    row = (app_id, job, started, dt.datetime.now(dt.UTC), n_rows())
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)
