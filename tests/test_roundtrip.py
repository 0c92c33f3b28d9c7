"""What goes into an encrypted table comes out unchanged."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.plans import jobs
from sealtable.functions.payload import as_schema, decode, encode, pick_format
from sealtable.session import work_path
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_table

AWKWARD = ["\\", "N", "n", "s", "r", "t", '"', ",", "\n", "\r", "\t", " ", "é", "𝄞", "\x00", "\x01", " ", "#", "'", "﻿", "\x85"]

FIXED = ["", " ", "\\N", "\\", '"', '""', '\\"', "a\r\nb", "\n", ",", " a ", "null", "\\s", "\\n", "\\\\N", "NaN", None]


def strings(n):
    rng = random.Random(5)
    return FIXED + ["".join(rng.choices(AWKWARD, k=rng.randint(0, 8))) for _ in range(n)]


@pytest.mark.parametrize("fmt", ["csv", "json"])
@pytest.mark.parametrize("options", [{"layout": "line"}, {"layout": "parquet"}, {"block_bytes": 0}, {"block_bytes": 64}, {"codec": "zstd"}])
def test_awkward_strings(spark, keyring, fmt, options):
    rows = [(i, s, s) for i, s in enumerate(strings(1500))]
    df = spark.createDataFrame(rows, "i int, s string, s2 string")
    path = work_path(spark, "awkward")
    write_table(df, path, keyring, fmt=fmt, **options)
    back = read_table(spark, path, df.schema, keyring, layout=options.get("layout", "line"), fmt=fmt, codec=options.get("codec"))
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[0]) == rows


def test_single_string_column(spark, keyring):
    rows = [(s,) for s in strings(300)]
    df = spark.createDataFrame(rows, "s string")
    path = work_path(spark, "single")
    write_table(df, path, keyring)
    back = read_table(spark, path, df.schema, keyring)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(rows, key=repr)


ALL_TYPES = (
    "b tinyint, sh smallint, i int, l bigint, f float, d double, dec decimal(20,4), t boolean, "
    "day date, ts timestamp, ntz timestamp_ntz, s string, `odd name` string, `q``,\"` int"
)


def typed_rows():
    utc = dt.UTC
    return [
        (1, 2, 3, 4, 0.1, 1e-300, Decimal("1234567890123456.7891"), True, dt.date(2024, 2, 29),
         dt.datetime(2024, 1, 1, 0, 0, 0, 123456, utc), dt.datetime(1999, 12, 31, 23, 59, 59, 999999), "x", "y", 5),
        (-128, -32768, -(2**31), -(2**63), -0.0, float("inf"), Decimal("-0.0001"), False, dt.date(1, 1, 1),
         dt.datetime(1880, 1, 1, 0, 0, 0, 1, utc), dt.datetime(1, 1, 1, 0, 0, 0, 1), "", "", 0),
        (127, 32767, 2**31 - 1, 2**63 - 1, 3.4028235e38, float("-inf"), Decimal("0"), None, dt.date(9999, 12, 31),
         dt.datetime(2024, 10, 27, 0, 30, tzinfo=utc), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), "\\N", ",", 1),
        (None,) * 14,
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Europe/Berlin"])
@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_every_flat_type(spark, keyring, fmt, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        schema = as_schema(ALL_TYPES)
        assert pick_format(schema) == "csv"
        df = spark.createDataFrame(typed_rows(), schema)
        path = work_path(spark, "typed")
        write_table(df, path, keyring, fmt=fmt)
        back = read_table(spark, path, schema, keyring, fmt=fmt)
        # As text of the exact values, so that -0.0 and instants are told apart.
        exact = [F.unix_micros("ts").alias("ts")] + [F.col(f"`{n.replace('`', '``')}`").cast("string") for n in schema.names if n != "ts"]
        assert sorted(map(str, back.select(exact).collect())) == sorted(map(str, df.select(exact).collect()))
        # The stored text does not depend on the reader's zone.
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        moved = read_table(spark, path, schema, keyring, fmt=fmt)
        micros = F.unix_micros("ts")
        assert sorted(map(str, moved.select(micros).collect())) == sorted(map(str, df.select(micros).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_nan(spark, keyring):
    df = spark.createDataFrame([(float("nan"),)], "d double")
    path = work_path(spark, "nan")
    write_table(df, path, keyring)
    assert read_table(spark, path, df.schema, keyring).where(F.isnan("d")).count() == 1


def test_nested_types_use_json(spark, keyring):
    df = spark.sql("""select id, array(id, null) as a, named_struct('x', id, 'y', cast(null as string)) as st,
                      map('k', cast(id as double)) as m, cast('ab' as binary) as bin from range(50)""")
    assert pick_format(df.schema) == "json"
    path = work_path(spark, "nested")
    write_table(df, path, keyring)
    back = read_table(spark, path, df.schema, keyring)
    key = lambda r: r.id
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)


def test_empty_table(spark, keyring):
    df = spark.createDataFrame([], "a int, b string")
    path = work_path(spark, "empty")
    write_table(df, path, keyring)
    assert read_table(spark, path, df.schema, keyring).count() == 0


def test_malformed_line_fails(spark):
    schema = as_schema("a int, b string")
    bad = spark.createDataFrame([("x1,y",)], "line string")
    with pytest.raises(Exception, match="(?i)malformed"):
        decode(bad, schema, "csv").collect()


def test_lines_hold_no_line_breaks(spark):
    df = spark.createDataFrame([(s,) for s in strings(500)], "s string")
    assert encode(df, "csv").where("line rlike '[\\n\\r]'").count() == 0


def test_plain_csv(spark):
    rows = [(1, "a,b", "\\x"), (2, 'q"q', ""), (3, " lead", None)]
    df = spark.createDataFrame(rows, "i int, s string, t string")
    path = work_path(spark, "plain")
    write_table(df, path, crypto_mode="plain_text", partitions=1)
    back = read_table(spark, path, df.schema, crypto_mode="plain_text")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_plain_csv_refuses_what_it_cannot_hold(spark):
    df = spark.createDataFrame([("\\N",)], "s string")
    with pytest.raises(Exception, match="not representable"):
        write_table(df, work_path(spark, "plain"), crypto_mode="plain_text")


@pytest.mark.parametrize("mode", ["plain_text", "AES/CBC/PKCS5Padding"])
def test_plain_csv_with_line_breaks(spark, keyring, mode):
    """Refused, or exact with multi_line; count agrees with the rows."""
    rows = [("a\nb",), ("c",), ("d\re",), ("f\r\ng",), ("\n",), ('q"\n"',), ("",), (None,), (" x\n",)]
    df = spark.createDataFrame(rows, "s string")
    with pytest.raises(Exception, match="multi_line"):
        write_table(df, work_path(spark, "plain"), crypto_mode="plain_text")
    plain, target = work_path(spark, "plain"), work_path(spark, "target")
    write_table(df, plain, crypto_mode="plain_text", multi_line=True)
    jobs.transcode(spark, plain, target, df.schema, "plain_text", mode, keyring, multi_line=True)
    for path, kind in ((plain, "plain_text"), (target, mode)):
        back = read_table(spark, path, df.schema, keyring, kind, multi_line=True)
        assert back.count() == len(rows) and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_types_of_schema_survive(spark, keyring):
    df = spark.createDataFrame([(1, Decimal("1.5"))], "a smallint, d decimal(10,2)")
    path = work_path(spark, "types")
    write_table(df, path, keyring)
    back = read_table(spark, path, df.schema, keyring)
    assert [f.dataType for f in back.schema] == [T.ShortType(), T.DecimalType(10, 2)]


@pytest.mark.parametrize("options", [{}, {"layout": "parquet"}, {"layout": "parquet", "codec": "zstd"}])
def test_another_schema_is_refused(spark, keyring, options):
    """Swapped columns, another name and another type fail instead of giving other values."""
    df = spark.createDataFrame([(1, 2, "x")], "a int, b int, s string")
    path = work_path(spark, "sealed")
    write_table(df, path, keyring, **options)
    assert read_table(spark, path, df.schema, keyring, **options).first() == (1, 2, "x")
    for other in ("b int, a int, s string", "a int, c int, s string", "a int, b long, s string", "a int, b int"):
        with pytest.raises(Exception, match="another schema"):
            read_table(spark, path, other, keyring, **options).collect()


def test_wrong_codec_fails(spark, keyring):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    packed, plain = work_path(spark, "packed"), work_path(spark, "plain")
    write_table(df, packed, keyring, codec="zstd")
    write_table(df, plain, keyring)
    with pytest.raises(Exception, match="codec='zstd'"):
        read_table(spark, packed, df.schema, keyring).collect()
    with pytest.raises(Exception, match="(?i)zstd"):
        read_table(spark, plain, df.schema, keyring, codec="zstd").collect()
    with pytest.raises(ValueError, match="codec"):
        write_table(df, work_path(spark, "x"), keyring, codec="rar")


def test_zstd_survives_rekeying(spark):
    from sealtable.plans import jobs
    from sealtable.plans.secure_queries import new_keyring

    ring, df = new_keyring(spark), spark.range(5000).withColumn("s", F.lit("text"))
    path, moved = work_path(spark, "a"), work_path(spark, "b")
    write_table(df, path, ring, layout="parquet", codec="zstd")
    ring = ring.add_key()
    jobs.rekey_table(spark, path, moved, ring, layout="parquet")
    back = read_table(spark, moved, df.schema, ring, layout="parquet", codec="zstd")
    assert back.exceptAll(df).count() == 0 and back.count() == 5000


@pytest.mark.parametrize("fmt", ["csv", "json"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_values_over_the_whole_range(spark, fmt, zone):
    """Instants and dates from BC to year 11000, doubles of every size, decimals down to 1e-18."""
    bits = [F.xxhash64("id", F.lit(i)) for i in range(6)]
    micros = [(b % F.lit(9 * 10**18) / 31).cast("bigint") for b in bits]
    power = F.pow(F.lit(10.0), F.col("id") % 600 - 300)
    df = spark.range(20_000).select(
        "id",
        F.timestamp_micros(micros[0]).alias("ts"),
        F.timestamp_micros(micros[1]).cast("timestamp_ntz").alias("ntz"),
        F.date_from_unix_date((bits[2] % 3_000_000).cast("int")).alias("day"),
        (F.when(bits[3] % 3 == 0, 0).otherwise(bits[3] % 1000) * F.lit(Decimal("0.000000000000000001")))
        .cast("decimal(38,18)")
        .alias("dec"),
        (bits[4].cast("double") * power).alias("dbl"),
        (bits[5].cast("double") * F.pow(F.lit(10.0), F.col("id") % 70 - 50)).cast("float").alias("flt"),
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        back = decode(encode(df, fmt), df.schema, fmt)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
