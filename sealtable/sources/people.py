"""The sample table: people with a name, an age and a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.functions import draw
from sealtable.operators.relational import JOBS

# Bounds of the sample data, and its usual size.
AGES = (18, 60)
NAME_LENGTHS = (3, 7)
SAMPLE_ROWS = 87


def people_columns(row_id: Column, seed: int = 0, portable: bool = False) -> list[Column]:
    """Name, age and job drawn for a row id."""
    return [
        draw.word(seed, *NAME_LENGTHS, row_id, "name", portable=portable).alias("name"),
        draw.integer(seed, *AGES, row_id, "age", portable=portable).alias("age"),
        draw.choice(seed, JOBS, row_id, "job", portable=portable).alias("job"),
    ]


def people(spark: SparkSession, n: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """``n`` generated people; any number of tasks gives the same rows."""
    return spark.range(n).select(*people_columns(F.col("id"), seed))
