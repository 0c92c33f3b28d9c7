"""Thousands of search strings at once: filling placeholders and keeping lines.

One expression per string makes a plan that grows with the list, and a scan of the text per
string.  Here the strings come from a table, are sent to the workers once, and each worker
builds one automaton that finds all of them in one walk over a text.

The order of placeholders keeps its meaning: the result is that of replacing the first
everywhere, then the second in what came out, and so on.  A string that does not occur when
its turn comes changes nothing, so only those that the automaton finds are replaced, in
order, and the text is walked again after each, as a value may bring in later strings.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of strings and values that are sent to every worker; a larger list is refused.
MOST_BYTES = 64 * 1024 * 1024

_automata: dict[str, tuple] = {}


def _gathered(patterns: DataFrame, columns: list[Column], order: list[str]) -> list:
    """The rows of a list whose size has been checked, in order."""
    size = sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in columns), F.lit(0)) + 16
    total = patterns.agg(F.sum(size)).first()[0] or 0
    if total > MOST_BYTES:
        raise ValueError(f"a list of {total} bytes is too large to send to every worker; fill in several steps")
    return [tuple(r) for r in patterns.orderBy(*order).select(*columns).collect()]


def _automaton(sent) -> tuple:
    """``(automaton, strings, reach)`` of this worker; string numbers stand at the words they
    equal."""
    import ahocorasick

    name, rows = sent.value
    if name not in _automata:
        _automata.clear()  # one list at a time keeps a worker small
        places: dict[str, list[int]] = {}
        for k, (mark, *_) in enumerate(rows):
            if mark:
                places.setdefault(mark, []).append(k)
        automaton = ahocorasick.Automaton()
        for mark, numbers in places.items():
            automaton.add_word(mark, numbers)
        automaton.make_automaton()
        _automata[name] = (automaton if places else None, rows, max(map(len, places), default=1) - 1)
    return _automata[name]


def fill_text(text: str, automaton, rows: list, reach: int) -> str:
    """Successive replacement by ``rows`` of mark, value and whether only its first place;
    ``reach`` is one less than the length of the longest mark."""
    waiting = list({k for _, numbers in automaton.iter(text) for k in numbers})
    heapq.heapify(waiting)
    seen = set(waiting)
    while waiting:
        turn = heapq.heappop(waiting)
        mark, value, first_only = rows[turn]
        parts = text.split(mark, 1 if first_only else -1)
        if len(parts) == 1:
            continue  # an earlier replacement took it away
        text, at = value.join(parts), 0
        for part in parts[:-1]:
            at += len(part)
            for _, numbers in automaton.iter(text, max(0, at - reach), min(len(text), at + len(value) + reach)):
                for k in numbers:
                    if k > turn and k not in seen:
                        seen.add(k)
                        heapq.heappush(waiting, k)
            at += len(value)
    return text


def _over_texts(sent, kind: str, use: Callable) -> Callable:
    @F.pandas_udf(kind)
    def run(texts):
        import pandas as pd

        found = _automaton(sent)
        return pd.Series([None if t is None else use(t, *found) for t in texts], dtype=object)

    return run


def filled_from(
    df: DataFrame,
    column: str,
    patterns: DataFrame,
    mark: str = "mark",
    value: str = "value",
    order: str = "position",
    first_only: str | None = None,
) -> DataFrame:
    """``df`` with the placeholders of ``patterns`` filled in ``column``, in the order of ``order``.

    Rows of ``patterns`` whose ``first_only`` is true are filled at their first place only.
    Empty or null marks fill nothing, a null value counts as empty.
    """
    once = F.coalesce(F.col(first_only), F.lit(False)) if first_only else F.lit(False)
    rows = _gathered(patterns, [F.col(mark), F.coalesce(F.col(value), F.lit("")), once], [order, mark])
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
    fill = _over_texts(sent, "string", lambda t, automaton, *rest: fill_text(t, automaton, *rest) if automaton else t)
    return df.withColumn(column, fill(F.col(column)))


def containing_any(df: DataFrame, needles: DataFrame, column: str = "line", needle: str = "needle") -> DataFrame:
    """Rows whose ``column`` contains one of the strings at least; empty strings count for nothing."""
    rows = _gathered(needles.select(needle).distinct(), [F.col(needle)], [needle])
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
    found = _over_texts(sent, "boolean", lambda t, automaton, *_: automaton is not None and next(automaton.iter(t), None) is not None)
    return df.where(F.coalesce(found(F.col(column)), F.lit(False)))


def found_strings(df: DataFrame, needles: DataFrame, column: str = "line", needle: str = "needle", name: str = "found") -> DataFrame:
    """``df`` with the array of those strings that ``column`` contains, each once, in order."""
    rows = _gathered(needles.select(needle).distinct(), [F.col(needle)], [needle])
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))

    def those(text: str, automaton, rows: list, _reach: int) -> list[str]:
        return [rows[k][0] for k in sorted({k for _, numbers in automaton.iter(text) for k in numbers})] if automaton else []

    return df.withColumn(name, _over_texts(sent, "array<string>", those)(F.col(column)))
