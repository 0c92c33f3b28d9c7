"""The relational core: the people query, conditional count, bounded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtable.operators.ranking import number_rows

# Rows that one task may sort and return as a whole.
AT_ONCE = 100_000

# Fixed values of the sample query and its data.
JOBS = ("Developer", "Engineer", "Researcher")
AGE_RANGE = (20, 40)
PEOPLE_SCHEMA = "name string, age int, job string"


def young_developers(job: Column | str = "job", age: Column | str = "age") -> Column:
    """Developers aged 20 to 40, both ends included."""
    job = F.col(job) if isinstance(job, str) else job
    age = F.col(age) if isinstance(age, str) else age
    return (job == JOBS[0]) & age.between(*AGE_RANGE)


def count_matching(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def first_rows(df: DataFrame, n: int, *order: str, at_once: int = AT_ONCE) -> DataFrame:
    """The first ``n`` rows of an order, each task keeping only ``n``.

    Up to ``at_once`` rows come sorted, out of one task.  More come out of as many tasks as
    they need, each holding a range of the order: rows are numbered by their range's start
    and their place in it, and those beyond ``n`` dropped.
    """
    if n <= at_once:
        return df.orderBy(*order).limit(n)
    return number_rows(df, [], list(order), "_place").where(F.col("_place") <= n).drop("_place")
