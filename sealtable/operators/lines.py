"""Operators on tables of text lines ``(doc, line_no, line)``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions import payload
from sealtable.functions import text as tx
from sealtable.operators.ranking import number_rows
from sealtable.session import held

# Lines after which a task notes how far it is.
CHUNK_LINES = 65_536


def split_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of a text column, numbered from 0.  Needs no shuffle."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def containing(lines: DataFrame, needle: str, column: str = "line") -> DataFrame:
    return lines.where(F.contains(F.col(column), F.lit(needle)))


def matching(lines: DataFrame, pattern: str, column: str = "line") -> DataFrame:
    return lines.where(F.col(column).rlike(pattern))


def without_header(lines: DataFrame) -> DataFrame:
    return lines.where("line_no > 0")


def last_value_per_key(
    lines: DataFrame,
    doc: Sequence[str],
    rules: Mapping[str, str],
    key: Column | None = None,
    value: Column | None = None,
    order: str = "line_no",
) -> DataFrame:
    """One row per document, one column per rule: the value on the last line whose key matches.

    By default the key is the first field of a line and the value the second.  The
    lines are read once, so a sealed table is decrypted once, and aggregated in part
    before the shuffle; a document without a match has no last value.
    """
    line = F.col("line")
    key = tx.field(line, 1) if key is None else key
    value = tx.field(line, 2) if value is None else value
    doc_id = F.struct(*doc).alias("_doc")  # a null id equals itself in this form
    keyed = lines.select(doc_id, key.alias("_key"), value.alias("_value"), F.col(order).alias("_at"))
    hit = [F.col("_key").rlike(pattern) for pattern in rules.values()]
    last = [F.max(F.when(h, F.struct("_at", "_value"))).alias(name) for name, h in zip(rules, hit, strict=True)]
    found = keyed.groupBy("_doc").agg(*last)
    return found.select("_doc.*", *[F.coalesce(F.col(name)["_value"], F.lit("")).alias(name) for name in rules])


def lines_after_marker(
    lines: DataFrame,
    marker: str,
    doc: Sequence[str] = ("doc_id",),
    order: str = "line_no",
    column: str = "line",
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Lines that directly follow a marker line, for documents spread over many rows.

    A taken line is consumed, so in a run of adjacent markers every second line is
    taken.  A line is taken exactly if an odd number of markers stands directly before
    it.  Places are counted, not read off ``order``, which may be any column that sorts and
    may have gaps.

    Rows are dealt by ranges of document and order, so a document of any size spreads over
    all tasks.  Each task walks its rows once, in stretches of ``chunk_lines``: the count of
    markers before a line is known unless only markers stand between it and the start of the
    stretch.  Of each stretch one row tells how many markers it ends in and whether it is
    nothing but markers; a running sum of these, which starts anew behind every stretch that
    is more, is what the first lines of the next one lack.  Only taken lines, those few and
    the rows of the sum are held for the second look.
    """
    extra = "_slice long, _kind int, _run long, _all boolean"
    schema = T.StructType([*lines.schema, *payload.as_schema(extra)])
    marked = lines.withColumn("_marker", F.coalesce(F.col(column).rlike(marker), F.lit(False)))
    ordered = marked.repartitionByRange(*doc, order).sortWithinPartitions(*doc, order)
    walked = held(ordered.mapInArrow(_marker_walk(list(doc), chunk_lines), schema))
    key = F.struct(*doc).alias("_doc")  # as a struct, a null document id equals itself in joins too

    # Where a stretch begins with open lines, and where each ends.
    kind, ending = F.col("_kind"), F.col("_kind") == _END
    events = walked.where(kind >= _OPEN).groupBy(key, "_slice", ending.alias("_at")).agg(
        F.max(F.when(ending, F.col("_run")).otherwise(0)).alias("_run"), F.min(~ending | F.col("_all")).alias("_all")
    )
    earlier = Window.partitionBy("_doc").orderBy("_slice", "_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = events.withColumn("_sum", F.coalesce(F.sum("_run").over(earlier), F.lit(0)))
    since = F.coalesce(F.max(F.when(~F.col("_all"), F.col("_sum"))).over(earlier), F.lit(0))
    carries = summed.withColumn("_carried", F.col("_sum") - since).where("not _at").select("_doc", "_slice", "_carried")
    found = walked.where(kind <= _OPEN).withColumn("_doc", key).join(carries, ["_doc", "_slice"], "left")
    odd = (F.col("_run") + F.col("_carried")) % 2 == 1
    return found.where((kind == _TAKEN) | odd).select(*lines.columns)


# What a walked row is: a line that is taken, one for which that depends on the stretches
# before, and the last line of a stretch, which carries its count.
_TAKEN, _OPEN, _END = 0, 1, 2


def _marker_walk(doc: list[str], chunk_lines: int):
    """The walk over one task's rows, which are in order; see :func:`lines_after_marker`."""

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(rows: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
            """Whether each row is of another document than the row before; the first row of a
            stretch counts as of the same."""
            both = rows if before is None else pa.Table.from_batches([before, rows]).combine_chunks()
            other = np.zeros(rows.num_rows, bool)
            at = 1 if before is None else 0
            for name in doc:
                column = both.column(name)
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                a, b = column.slice(0, len(column) - 1), column.slice(1)
                # Two nulls are equal, a null and a value are not.
                known = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                other[at:] |= known | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
            return other

        def noted(rows: pa.RecordBatch, kinds, runs, alls) -> pa.RecordBatch:
            n = rows.num_rows
            names = [c for c in rows.schema.names if c != "_marker"]
            more = [pa.array(np.full(n, number), pa.int64()), pa.array(kinds, pa.int32()), pa.array(runs, pa.int64()), pa.array(alls, pa.bool_())]
            return pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], *more], [*names, "_slice", "_kind", "_run", "_all"])

        number = TaskContext.get().partitionId() << 33
        last: pa.RecordBatch | None = None  # last row of the stretch so far
        size, run, only, in_first = 0, 0, True, True
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows = batch.slice(at, chunk_lines - size)
                n = rows.num_rows
                at, size = at + n, size + n
                new, is_marker = changes(rows, last), rows.column("_marker").to_numpy(zero_copy_only=False)
                place = np.arange(n)
                start = np.maximum.accumulate(np.where(new, place, -1))
                other = np.r_[-1, np.maximum.accumulate(np.where(is_marker, -1, place))][:-1]
                goes_on = (start < 0) & (other < 0)
                runs = np.where(goes_on, place + run, place - 1 - np.maximum(other, start - 1))
                is_open = goes_on & only & in_first
                wanted = is_open | (runs % 2 == 1)
                if wanted.any():
                    some = rows.filter(pa.array(wanted))
                    yield noted(some, np.where(is_open[wanted], _OPEN, _TAKEN), runs[wanted], np.zeros(wanted.sum(), bool))
                run = int(runs[-1]) + 1 if is_marker[-1] else 0
                only = bool(goes_on[-1] and is_marker[-1] and only)
                in_first = bool(in_first and start[-1] < 0)
                last = rows.slice(n - 1, 1)
                if size == chunk_lines:
                    yield noted(last, [_END], [run], [only and in_first])
                    number, last, size, run, only, in_first = number + 1, None, 0, 0, True, True
        if last is not None:
            yield noted(last, [_END], [run], [only and in_first])

    return walk


def with_sort_number(lines: DataFrame, delimiter: str, n: int, column: str = "line") -> DataFrame:
    """Add ``sort_number``, as a column: a sort would evaluate an expression at every comparison."""
    return lines.withColumn("sort_number", tx.numeric_part(F.col(column), delimiter, n))


def sorted_by_number(
    lines: DataFrame, delimiter: str, n: int, column: str = "line", tie_break: Sequence[str] = ("doc_id", "line_no")
) -> DataFrame:
    """A global sort by the number leading the n-th delimited part, then by the whole line.

    ``tie_break`` lets copies of one line spread over partitions.
    """
    keyed = with_sort_number(lines, delimiter, n, column)
    return keyed.orderBy("sort_number", column, *tie_break).drop("sort_number")


def numbered_by_number(
    lines: DataFrame, delimiter: str, n: int, column: str = "line", tie_break: Sequence[str] = ("doc_id", "line_no")
) -> DataFrame:
    """The same order as an explicit place ``pos`` from 1, with no task seeing all rows."""
    keyed = with_sort_number(lines, delimiter, n, column)
    return number_rows(keyed, [], ["sort_number", column, *tie_break], "pos")


def joined_items(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    tie_break: Sequence[str] = (),
    rewrite: tuple[str, str] | None = None,
    sep: str = ",",
    *,
    max_items: int,
) -> DataFrame:
    """The items of each group, in order, as one string ``items`` per ``part_no``.

    A group of up to ``max_items`` gives a single part 0.  Larger groups continue in
    parts 1, 2, ...; joining the parts with ``sep`` gives the whole.  All sizes have the
    same plan: rows are numbered by a range shuffle, and a part is one task's at most.
    """
    group = list(group)
    rows = df.select(*group, item, *tie_break).where(F.col(item).isNotNull())
    numbered = number_rows(rows, group, [item, *tie_break], "_pos")
    parts = numbered.withColumn("part_no", F.floor((F.col("_pos") - 1) / max_items).cast("bigint"))
    listed = F.sort_array(F.collect_list(F.struct("_pos", F.col(item).alias("_item"))))

    def shown(entry: Column) -> Column:
        return entry["_item"] if rewrite is None else F.replace(entry["_item"], F.lit(rewrite[0]), F.lit(rewrite[1]))

    return parts.groupBy(*group, "part_no").agg(F.array_join(F.transform(listed, shown), sep).alias("items"))
