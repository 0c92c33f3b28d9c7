"""Rows to text lines and back.

The CSV form is written with plain cast and concat expressions rather than
``to_csv``: casts keep microseconds and stay inside generated code.  A line never
contains a raw line break, so lines can be joined with ``\\n`` and split again.

CSV form: fields joined by commas; null is ``\\N``; strings are always quoted,
quotes doubled.  Inside strings a backslash, LF, CR and NUL become ``\\s``, ``\\n``,
``\\r`` and ``\\0``, hence no string can look like the null mark.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"

# The backslash comes first when writing and last when reading.
ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))

_PLAIN_CAST = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType,
)

# Offsets with seconds, because zones had such offsets before about 1900.
_ZONED = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX"
_UNZONED = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

_CSV_READ = {
    "mode": "FAILFAST",
    "nullValue": NULL_MARK,
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_JSON = {"timestampFormat": _ZONED, "timestampNTZFormat": _UNZONED}

# Options for whole CSV files (Spark's own reader and writer).
CSV_FILE = {
    "header": "true",
    "nullValue": NULL_MARK,
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": _ZONED,
    "timestampNTZFormat": _UNZONED,
}


def pick_format(schema: T.StructType) -> str:
    """``csv`` for flat schemas, ``json`` as soon as one column is not flat."""
    flat = all(isinstance(f.dataType, (*_PLAIN_CAST, T.StringType, T.TimestampType)) for f in schema)
    return "csv" if flat else "json"


def schema_mark(schema: T.StructType, fmt: str) -> bytes:
    """Eight bytes that tell one schema and format from another: names, types and order."""
    shown = [fmt, *(f"{f.name}:{f.dataType.simpleString()}" for f in schema)]
    return hashlib.sha256(json.dumps(shown).encode()).digest()[:8]


def as_schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _sub(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), _sub(text, '"', '""'), F.lit('"'))


def _escaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = _sub(text, raw, code)
    return text


def _unescaped(text: Column) -> Column:
    restored = text
    for raw, code in reversed(ESCAPES):
        restored = _sub(restored, code, raw)
    return F.when(F.contains(text, F.lit("\\")), restored).otherwise(text)


def _refused(bad: Column, text: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit("string not representable in plain CSV; line breaks need multi_line")).cast("string")).otherwise(text)


def _representable(text: Column) -> Column:
    unsafe = [F.contains(text, F.lit(c)) for c in ("\n", "\r", "\0")]
    return _refused((text == NULL_MARK) | unsafe[0] | unsafe[1] | unsafe[2], text)


def plain_strings(df: DataFrame, multi_line: bool = False) -> DataFrame:
    """``df``, failing on a string that Spark's CSV reader would take for null, and on a
    line break unless the file is going to be read with ``multi_line``."""

    def bad(text: Column) -> Column:
        return (text == NULL_MARK) if multi_line else (text == NULL_MARK) | text.rlike("[\\n\\r]")

    return df.select(
        *[
            _refused(bad(column(f.name)), column(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else column(f.name)
            for f in df.schema
        ]
    )


def _csv_field(field: T.StructField, escape: bool) -> Column:
    value = column(field.name)
    if isinstance(field.dataType, T.StringType):
        text = _quoted(_escaped(value) if escape else _representable(value))
    elif isinstance(field.dataType, T.TimestampType):
        text = F.date_format(value, _ZONED)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def csv_line(schema: T.StructType, escape: bool = True) -> Column:
    """One row as one CSV line.

    ``escape=False`` gives ordinary CSV for exchange with other tools; a string
    that such a file cannot carry fails the job instead of changing.
    """
    return F.concat_ws(",", *[_csv_field(f, escape) for f in schema])


def csv_header(schema: T.StructType) -> str:
    return ",".join(schema.names)


def encode(df: DataFrame, fmt: str, name: str = "line") -> DataFrame:
    """A one-column table of text lines, one per row of ``df``."""
    if fmt == "json":
        whole = F.to_json(F.struct("*"), {**_JSON, "ignoreNullFields": "false"})
        return df.select(whole.alias(name))
    return df.select(csv_line(df.schema).alias(name))


def decode(lines: DataFrame, schema: T.StructType, fmt: str, escape: bool = True) -> DataFrame:
    """Parse the single column of ``lines``; a malformed line fails the job.

    The parse sits in a generator, which filters and projections above it cannot
    duplicate.
    """
    line, ddl = F.col(lines.columns[0]), schema.toDDL()
    if fmt == "json":
        return lines.select(F.inline(F.array(F.from_json(line, ddl, {**_JSON, "mode": "FAILFAST"}))))
    rows = lines.select(F.inline(F.array(F.from_csv(line, ddl, _CSV_READ))))
    if not escape:
        return rows
    strings = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    if not strings:
        return rows
    return rows.select(*[_unescaped(column(n)).alias(n) if n in strings else column(n) for n in schema.names])
