"""The columnar layout and its index: what is read, what is opened, what can be seen."""

import datetime as dt
import decimal
import os
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from sealtable.operators import skipping as sk
from sealtable.operators.skipping import Between, Equal
from sealtable.plans import jobs
from sealtable.plans.secure_queries import new_keyring, table
from sealtable.session import work_path
from sealtable.sources import columns as co
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sealed(df, keyring, **options):
    path = work_path(df.sparkSession, "columns")
    write_table(df, path, keyring, layout="columns", **options)
    return path


def indexed(df, keyring, path, names):
    index = work_path(df.sparkSession, "index")
    sk.build_index(df.sparkSession, path, index, keyring, df.schema, names)
    return index


def same(a, b):
    assert a.schema == b.schema
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_awkward_values_and_types(spark, keyring):
    schema = "s string, i int, l long, d double, f float, b boolean, c decimal(12,3), day date, ts timestamp, n timestamp_ntz, raw binary, a array<string>, m map<string,int>, st struct<x:int,y:array<double>>"
    row = ("a\n\"b\",\\N", 1, 2**60, 0.1, 0.5, True, decimal.Decimal("1.500"), dt.date(1900, 1, 1), dt.datetime(2024, 1, 1, 1, 2, 3, 456789), dt.datetime(1, 1, 1), bytearray(b"\0\xff"), ["x", None, ""], {"k": 1, "l": None}, (1, [float("nan"), None]))
    rows = [row, tuple([None] * len(row)), ("", -1, -(2**63), float("-inf"), -0.0, False, decimal.Decimal(0), dt.date(9999, 12, 31), dt.datetime(1970, 1, 1), dt.datetime(9999, 1, 1), bytearray(), [], {}, (None, None))]
    df = spark.createDataFrame(rows, schema)
    path = sealed(df, keyring, codec="zstd")
    back = read_table(spark, path, df.schema, keyring, layout="columns")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    some = read_table(spark, path, df.schema, keyring, layout="columns", columns=["m", "s"])
    assert some.columns == ["m", "s"]
    assert sorted(map(repr, some.collect())) == sorted(map(repr, df.select("m", "s").collect()))


def test_empty_table_and_unknown_columns(spark, keyring):
    none = spark.createDataFrame([], "a int, b string")
    path = sealed(none, keyring)
    assert read_table(spark, path, none.schema, keyring, layout="columns").collect() == []
    assert co.count_rows(spark, path).first().n == 0
    index = indexed(none, keyring, path, ["a"])
    assert sk.read_where(spark, path, index, keyring, none.schema, [Equal("a", 1)]).collect() == []
    for columns in (["c"], ["a", "a"], []):
        with pytest.raises(ValueError):
            read_table(spark, path, none.schema, keyring, layout="columns", columns=columns)


def test_only_wanted_bodies_are_scanned_and_opened(spark, keyring):
    df = table(spark, SF_DIR, "lineitem")
    path = sealed(df, keyring)
    two = read_table(spark, path, df.schema, keyring, layout="columns", columns=["l_orderkey", "l_shipdate"])
    plan = plan_of(two)
    read = re.search(r"ReadSchema: struct<([^>]*c\d[^>]*)>", plan).group(1)
    assert set(re.findall(r"\bc\d+\b", read)) == {"c0", "c10"}
    # One site per body, and one for the unwrap of the keys.
    assert plan.count("aesDecrypt") == 3
    same(two, df.select("l_orderkey", "l_shipdate"))


def test_blocks_hold_rows_of_many_batches(spark, keyring):
    # Batches have 10,000 rows; a block is closed by its own bounds only.
    df = spark.range(0, 100_000, 1, 1).withColumn("v", F.col("id") * 2)
    sizes = [r.n_rows for r in co.scan_columns(spark, sealed(df, keyring), []).collect()]
    assert sorted(sizes) == [100_000 - co.BLOCK_ROWS, co.BLOCK_ROWS]
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert co.scan_columns(spark, sealed(long, keyring), []).count() >= 8


def test_wrong_schema_key_or_body_is_refused(spark, keyring):
    df = table(spark, SF_DIR, "nation")
    path = sealed(df, keyring)
    renamed = df.withColumnRenamed("n_name", "other").schema
    with pytest.raises(Exception, match="another schema"):
        read_table(spark, path, renamed, keyring, layout="columns").collect()
    with pytest.raises(Exception, match="no data key|check value|AES_CRYPTO"):
        read_table(spark, path, df.schema, new_keyring(spark), layout="columns").collect()
    swapped = spark.read.parquet(path).selectExpr("key_id", "block", "n_rows", "c2 as c0", "c1", "c0 as c2")
    other = work_path(spark, "swapped")
    swapped.write.parquet(other)
    with pytest.raises(Exception, match="another schema"):
        read_table(spark, other, df.schema, keyring, layout="columns").collect()


def opened(spark, path, index, keyring, schema, tests):
    return sk.kept_blocks(spark, path, index, keyring, schema, tests).count(), co.scan_columns(spark, path, []).count()


def test_clustered_table_opens_few_blocks(spark, keyring):
    df = table(spark, "/root/testdata/sf0.01", "lineitem").repartition(4)
    path = sealed(df, keyring, cluster_by=["l_orderkey"], block_rows=512)
    index = indexed(df, keyring, path, ["l_orderkey", "l_returnflag"])
    tests = [Between("l_orderkey", 2000, 2400), Equal("l_returnflag", "R")]
    kept, all_blocks = opened(spark, path, index, keyring, df.schema, tests)
    assert 0 < kept < 0.1 * all_blocks
    found = sk.read_where(spark, path, index, keyring, df.schema, tests)
    same(found, df.where("l_orderkey between 2000 and 2400 and l_returnflag = 'R'"))
    assert "In(block" in plan_of(found)  # the scan itself is told which blocks to read
    some = sk.read_where(spark, path, index, keyring, df.schema, tests, ["l_tax"])
    same(some, df.where("l_orderkey between 2000 and 2400 and l_returnflag = 'R'").select("l_tax"))


def test_equality_skips_unsorted_blocks_by_the_filter(spark, keyring):
    df = spark.range(0, 20_000, 1, 1).select((F.xxhash64("id") % 1_000_000).alias("k"), F.col("id").cast("string").alias("s"))
    path = sealed(df, keyring, block_rows=200)
    index = indexed(df, keyring, path, ["k", "s"])
    value = df.where("s = '777'").first()
    for tests in ([Equal("k", value.k)], [Equal("s", "777")]):
        kept, all_blocks = opened(spark, path, index, keyring, df.schema, tests)
        assert all_blocks == 100 and 1 <= kept <= 8
        assert sk.read_where(spark, path, index, keyring, df.schema, tests).collect() == [value]
    assert sk.read_where(spark, path, index, keyring, df.schema, [Equal("s", "none")]).collect() == []


def test_many_kept_blocks_are_joined(spark, keyring, monkeypatch):
    df = spark.range(0, 5000, 1, 1).withColumn("v", F.col("id") % 7)
    path = sealed(df, keyring, block_rows=100)
    index = indexed(df, keyring, path, ["id"])
    monkeypatch.setattr(sk, "LISTED_BLOCKS", 3)
    same(sk.read_where(spark, path, index, keyring, df.schema, [Between("id", 1000, 4000)]), df.where("id between 1000 and 4000"))


def test_every_type_and_bound(spark, keyring):
    nan = float("nan")
    rows = [(None, None, None, None, None, None)]
    for k in range(300):
        text = "p" * 70 + f"{k:03d}" if k % 2 else f"é{k:03d}"
        rows.append((text, k - 150, (k - 150) / 4, decimal.Decimal(k) / 4, dt.date(2020, 1, 1) + dt.timedelta(k), dt.datetime(2020, 1, 1) + dt.timedelta(hours=k)))
    rows += [("z", 5, nan, decimal.Decimal(1), dt.date(2021, 1, 1), dt.datetime(2021, 1, 1)), ("z", 6, -0.0, decimal.Decimal(1), dt.date(2021, 1, 1), dt.datetime(2021, 1, 1))]
    df = spark.createDataFrame(rows, "s string, i int, d double, c decimal(9,2), day date, ts timestamp").coalesce(1)
    path = sealed(df, keyring, block_rows=7)
    index = indexed(df, keyring, path, df.columns)
    cases = [
        [Equal("s", "é012")], [Equal("s", "p" * 70 + "013")], [Between("s", "p" * 70 + "100", "p" * 70 + "200")], [Between("s", "é", None)],
        [Equal("i", -3)], [Between("i", None, -140)], [Between("i", 100, None)], [Between("i", 10.5, 12.5)], [Between("i", 9, 3)],
        [Equal("d", 0.0)], [Equal("d", nan)], [Between("d", 30.0, None)], [Between("d", nan, None)], [Between("d", None, nan)], [Between("d", 37.25, nan)],
        [Equal("c", decimal.Decimal("2.5"))], [Between("c", 70, 71)],
        [Equal("day", dt.date(2020, 5, 5))], [Between("day", dt.date(2020, 5, 5), dt.date(2020, 5, 8))],
        [Equal("ts", dt.datetime(2020, 1, 3, 5))], [Between("ts", dt.datetime(2020, 1, 3), dt.datetime(2020, 1, 4))],
        [Equal("i", 4), Equal("s", "é154")], [Equal("i", 4), Between("i", 5, 6)], [Equal("s", None)], [Between("i")],
    ]
    for tests in cases:
        want = df
        for t in tests:
            want = want.where(t.rows())
        got = sk.read_where(spark, path, index, keyring, df.schema, tests)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), tests


def test_index_grows_and_outlives_rotation(spark):
    keyring = new_keyring(spark)
    df = spark.range(0, 1000, 1, 1).withColumn("v", F.col("id") * 3)
    path = sealed(df.where("id < 500"), keyring, block_rows=50)
    index = indexed(df, keyring, path, ["id"])
    write_table(df.where("id >= 500"), path, keyring, layout="columns", block_rows=50, save_mode="append")
    tests = [Between("id", 490, 510)]
    # Blocks that the index lacks are read.
    assert opened(spark, path, index, keyring, df.schema, tests)[0] == 11
    same(sk.read_where(spark, path, index, keyring, df.schema, tests), df.where("id between 490 and 510"))
    for _ in range(2):
        sk.build_index(spark, path, index, keyring, df.schema, ["id", "v"])
        assert sk.read_index(spark, index).count() == 40
    assert opened(spark, path, index, keyring, df.schema, tests)[0] == 2
    keyring, moved = keyring.add_key(), work_path(spark, "moved")
    jobs.rekey_table(spark, path, moved, keyring, layout="columns")
    assert {r.key_id for r in co.scan_columns(spark, moved, []).collect()} == {keyring.active_id}
    same(sk.read_where(spark, moved, index, keyring, df.schema, tests), df.where("id between 490 and 510"))
    assert opened(spark, moved, index, keyring, df.schema, tests)[0] == 2
    again = work_path(spark, "again")
    jobs.rekey_table(spark, moved, again, keyring, layout="columns")
    assert spark.read.parquet(moved).exceptAll(spark.read.parquet(again)).count() == 0


def test_nothing_plain_in_table_and_index(spark, keyring):
    df = spark.createDataFrame([(f"secret-{k:04d}", k) for k in range(500)], "word string, number int").coalesce(1)
    path = sealed(df, keyring, block_rows=100)
    index = indexed(df, keyring, path, ["word", "number"])
    for folder in (path, index):
        for file in pathlib.Path(folder.removeprefix("file://")).glob("*.parquet"):
            raw = file.read_bytes()
            assert b"secret" not in raw and b"word" not in raw and b"number" not in raw
    blooms = [bytes(r.bloom) for r in sk.read_index(spark, index).where("position = 0").collect()]
    other = new_keyring(spark)
    again = [bytes(r.bloom) for r in sk.read_index(spark, indexed(df, other, sealed(df, other, block_rows=100), ["word"])).collect()]
    assert not set(blooms) & set(again)  # the same values under another key set other bits


def test_unindexable_column_is_refused(spark, keyring):
    df = spark.createDataFrame([([1], 1)], "a array<int>, b int")
    with pytest.raises(ValueError, match="cannot be indexed"):
        indexed(df, keyring, sealed(df, keyring), ["a"])


def test_command_line(spark, capsys):
    from sealtable.__main__ import main
    from sealtable.operators.relational import PEOPLE_SCHEMA, young_developers
    from sealtable.sources.people import people

    keys = ["--primaryKeyPath", work_path(spark, "p"), "--dataKeyPath", work_path(spark, "k"), "--appId", "demo"]
    plain, sealed_path, index, moved, found, result = (work_path(spark, n) for n in ("plain", "s", "index", "moved", "found", "result"))
    io = lambda a, b: ["--inputPath", a, "--outputPath", b]
    columnar = ["--inputLayout", "columns"]
    main(["generate-keys", *keys], spark)
    main(["generate-people", "--outputPath", plain, "--rows", "400"], spark)
    capsys.readouterr()
    main(["encrypt", *keys, *io(plain, sealed_path), "--outputLayout", "columns", "--clusterBy", "age"], spark)
    main(["index", *keys, *io(sealed_path, index), "--columns", "age,job"], spark)
    main(["add-key", *keys], spark)
    main(["rekey", *keys, *io(sealed_path, moved), "--layout", "columns"], spark)
    tests = ["--equals", "job=Developer", "--between", "age=20,40"]
    main(["query", *keys, *io(moved, found), *columnar, "--index", index, *tests, "--outputLayout", "file"], spark)
    main(["decrypt", *keys, *io(found, result), "--inputLayout", "file"], spark)
    want = people(spark, 400).where(young_developers())
    got = read_table(spark, result, PEOPLE_SCHEMA, crypto_mode="plain_text")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    main(["query", *keys, *io(moved, work_path(spark, "q")), *columnar, *tests, "--columns", "name"], spark)
    with pytest.raises(ValueError, match="index"):
        main(["query", *keys, *io(moved, work_path(spark, "q")), "--index", index, *tests], spark)
