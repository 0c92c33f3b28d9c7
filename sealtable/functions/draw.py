"""Reproducible random values, derived from a seed, a row id and a label.

The same row gets the same values in any partitioning, and after a lost task is
repeated.  ``portable`` draws use MD5, which other engines can recompute; the
default hash is much cheaper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(seed: int, parts: Sequence[Column | str], portable: bool) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    if not portable:
        return F.xxhash64(F.lit(seed), *cols)
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def integer(seed: int, lo: int, hi: int, *parts: Column | str, portable: bool = False) -> Column:
    """An integer from ``lo`` to ``hi``, both included."""
    return (F.lit(lo) + F.pmod(_bits(seed, parts, portable), F.lit(hi - lo + 1))).cast("int")


def word(seed: int, shortest: int, longest: int, *parts: Column | str, portable: bool = False) -> Column:
    """A lower-case word of ``shortest`` to ``longest`` letters."""
    length = integer(seed, shortest, longest, *parts, "length", portable=portable)
    letters = F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.char(integer(seed, ord("a"), ord("z"), *parts, i, portable=portable)),
    )
    return F.array_join(letters, "")


def choice(seed: int, values: Sequence[str], *parts: Column | str, portable: bool = False) -> Column:
    """One of ``values``."""
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), integer(seed, 1, len(values), *parts, portable=portable)
    )
