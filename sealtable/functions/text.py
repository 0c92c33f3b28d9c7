"""Column functions on text lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS + "\n"))


def field(line: Column, n: int) -> Column:
    """The n-th field (from 1) between runs of blanks; empty when the line is shorter.

    The pattern stops at that field, so long lines are not split up to their end.
    """
    return F.regexp_extract(line, f"^[ \t\n]*(?:[^ \t\n]+[ \t\n]+){{{n - 1}}}([^ \t\n]+)", 1)


def first_and_rest(line: Column) -> tuple[Column, Column]:
    """The first field, and everything after it."""
    text = _stripped(line)
    return F.regexp_extract(text, "^[^ \t\n]*", 0), F.regexp_replace(text, "^[^ \t\n]*[ \t\n]*", "")


def replace_group(line: Column, pattern: str, replacement: str) -> Column:
    """Regex replacement; groups are written ``$1``."""
    return F.regexp_replace(line, pattern, replacement)


def map_chars(text: Column, old: str, new: str) -> Column:
    """Replace each character of ``old`` by the one at the same place in ``new``."""
    return F.translate(text, old, new)


def delete_chars(text: Column, char_class: str) -> Column:
    """Remove every character of a regex class such as ``[\\s-]``."""
    return F.regexp_replace(text, char_class, "")


def fill(
    text: Column, values: Sequence[tuple[str, Column | str]], first_only: Sequence[str] = ()
) -> Column:
    """Put values in place of placeholders, in the order given.

    Later placeholders also match inside values filled in earlier.  Placeholders in
    ``first_only`` are filled at their first place only.  Values may be columns.
    """
    for mark, value in values:
        value = F.lit(value) if isinstance(value, str) else value
        if mark in first_only:
            at = F.instr(text, mark)
            text = F.when(at > 0, F.overlay(text, value, at, F.lit(len(mark)))).otherwise(text)
        else:
            text = F.replace(text, F.lit(mark), value)
    return text


def json_fields(document: Column, paths: Sequence[str], sep: str = " ") -> Column:
    """Values at JSON paths joined by ``sep``; an absent value counts as empty."""
    parts = [F.coalesce(F.get_json_object(document, p), F.lit("")) for p in paths]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(sep), part)
    return joined


def to_base64(data: Column, wrap: int | None = None) -> Column:
    """Base64 text, on one line or wrapped with LF."""
    one_line = F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))
    return one_line if wrap is None else F.regexp_replace(one_line, f"(.{{{wrap}}})(?!$)", "$1\n")


def from_base64(text: Column) -> Column:
    return F.unbase64(text).cast("string")


def hex_digest(text: Column, bits: int = 512) -> Column:
    return F.sha2(text.cast("binary"), bits)


def after_last(text: Column, delimiter: str) -> Column:
    """Text after the last delimiter, or all of it when there is none."""
    return F.substring_index(text, delimiter, -1)


def glob_match(path: Column, glob: str) -> Column:
    """Shell pattern with ``*`` and ``?`` against the whole value."""
    if "[" in glob:
        raise ValueError("character sets are not supported in a glob")
    quoted = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return path.like(quoted.replace("*", "%").replace("?", "_"))


def prefixed(line: Column, prefix: str = "    ") -> Column:
    return F.concat(F.lit(prefix), line)


def route(value: Column, classes: Mapping[str, Sequence[str]], default: str) -> Column:
    """The class whose list holds the value, else the default; null counts as empty."""
    value = F.coalesce(value, F.lit(""))
    out = None
    for name, members in classes.items():
        test, result = value.isin(*members), F.lit(name)
        out = F.when(test, result) if out is None else out.when(test, result)
    return F.lit(default) if out is None else out.otherwise(default)


def numeric_part(line: Column, delimiter: str, n: int) -> Column:
    """Leading number of the n-th delimited part, as a value that sorts like it.

    The number may have any number of digits: the result is a struct of its sign, the
    length of its whole part, its whole digits and its decimals, without outer zeros.
    For a negative number length and digits are turned around, and the decimals end in
    a sign above all digits, so that the larger magnitude comes first.  Zero, and a part
    without a number, have sign 0.
    """
    part = F.split_part(line, F.lit(delimiter), F.lit(n))
    sign = F.regexp_extract(part, r"^[ \t]*(-?)", 1)
    whole = F.regexp_extract(part, r"^[ \t]*-?0*([0-9]*)", 1)
    decimals = F.regexp_replace(F.regexp_extract(part, r"^[ \t]*-?[0-9]*\.([0-9]*)", 1), "0+$", "")
    zero = (whole == "") & (decimals == "")
    digits, turned = "0123456789", "9876543210"
    size = F.length(whole)
    number = F.when(
        sign == "-",
        F.struct(
            F.lit(-1).alias("sign"),
            (-size).alias("size"),
            F.translate(whole, digits, turned).alias("whole"),
            F.concat(F.translate(decimals, digits, turned), F.lit("~")).alias("decimals"),
        ),
    ).otherwise(F.struct(F.lit(1).alias("sign"), size.alias("size"), whole.alias("whole"), decimals.alias("decimals")))
    none = F.struct(
        F.lit(0).alias("sign"), F.lit(0).alias("size"), F.lit("").alias("whole"), F.lit("").alias("decimals")
    )
    return F.when(F.coalesce(zero, F.lit(True)), none).otherwise(number)


def lines_after(text: Column, marker: str) -> Column:
    """Array of the lines that directly follow a marker line, within one text value.

    A line taken this way is consumed: it cannot act as a marker itself.  The walk
    is done by one left-to-right regex over a string holding one letter per line
    (m = marker, o = other, t = taken), so its cost is linear in the text.
    """
    lines = F.split(text, "\n")
    kinds = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(marker), "m").otherwise("o")), "")
    taken = F.split(F.regexp_replace(kinds, "m.", "ot"), "")
    chosen = F.zip_with(lines, taken, lambda x, k: F.when(k == "t", x))
    return F.filter(chosen, lambda x: x.isNotNull())


def last_value(text: Column, key_pattern: str, key: int = 1, value: int = 2) -> Column:
    """Within one text value, field ``value`` of the last line whose field ``key`` matches, else empty."""
    hits = F.filter(F.split(text, "\n"), lambda x: field(x, key).rlike(key_pattern))
    return F.coalesce(field(F.try_element_at(hits, F.lit(-1)), value), F.lit(""))
