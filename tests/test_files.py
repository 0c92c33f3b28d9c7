"""The file layout: keys named by files, files of full size, reading in splits, rotation."""

import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from sealtable.plans import jobs
from sealtable.plans.secure_queries import new_keyring, table
from sealtable.session import work_path
from sealtable.sources import files as fl
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(a, b):
    assert a.schema == b.schema
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def raw_files(folder):
    return {p.name: p.read_bytes() for p in pathlib.Path(folder.removeprefix("file://")).rglob("*.csv.cbc")}


def test_files_hold_rows_of_many_batches(spark, keyring):
    df = table(spark, "/root/testdata/sf0.1", "orders").coalesce(1)
    path = work_path(spark, "files")
    write_table(df, path, keyring, layout="file")
    assert len(raw_files(path)) == 1  # 150,000 rows in 15 batches are one file below 64 MB
    sizes = [len(r.content) for r in fl.seal_files(df, keyring, 1_000_000).collect()]
    assert len(sizes) > 5 and all(900_000 < s <= 1_000_200 for s in sizes[:-1])


def test_files_of_two_keys_are_read_as_one(spark):
    keyring = new_keyring(spark)
    df, path = table(spark, SF_DIR, "orders"), work_path(spark, "files")
    write_table(df.where("o_orderkey % 2 = 0"), f"{path}/old", keyring, layout="file")
    keyring = keyring.add_key()
    write_table(df.where("o_orderkey % 2 = 1"), f"{path}/new", keyring, layout="file")
    same(read_table(spark, path, df.schema, keyring, layout="file"), df)


def unnamed(spark, df, keyring, folder):
    """Files as another tool might write them: IV and ciphertext only."""
    files = fl.seal_files(df, keyring, 20_000)
    bare = files.withColumn("content", F.substring("content", fl.HEAD_BYTES + 1, 2**31 - 1))
    staged = work_path(spark, "staged")
    bare.write.parquet(staged)
    fl.export_files(spark.read.parquet(staged), folder)


def test_files_that_name_no_key_need_one(spark):
    keyring = new_keyring(spark)
    df, path, first = table(spark, SF_DIR, "customer"), work_path(spark, "bare"), keyring.active_id
    unnamed(spark, df, keyring, path)
    same(read_table(spark, path, df.schema, keyring, layout="file"), df)
    keyring = keyring.add_key()
    same(read_table(spark, path, df.schema, keyring, layout="file", key_id=first), df)
    with pytest.raises(Exception, match="AES_CRYPTO_ERROR|header"):
        read_table(spark, path, df.schema, keyring, layout="file").collect()


def test_rotation_goes_on_after_a_stop(spark):
    keyring = new_keyring(spark)
    df, path, target = table(spark, SF_DIR, "orders"), work_path(spark, "files"), work_path(spark, "rotated")
    write_table(df.where("o_orderkey % 2 = 0").repartition(4), f"{path}/a", keyring, layout="file")
    keyring = keyring.add_key()
    write_table(df.where("o_orderkey % 2 = 1").repartition(3), f"{path}/b", keyring, layout="file")
    jobs.rekey_table(spark, path, target, keyring, layout="file")
    before = raw_files(f"{target}/a")
    assert len(before) == 4 and all(c[:16] == fl.file_head(keyring.active_id) for c in before.values())
    assert raw_files(f"{target}/b") == raw_files(f"{path}/b")  # already under the key: copied
    same(read_table(spark, target, df.schema, keyring, layout="file"), df)
    # A run that was stopped left some files, and drafts of others.
    local = pathlib.Path(target.removeprefix("file://")) / "a"
    gone = sorted(local.glob("*.cbc"))[:2]
    for file in gone:
        file.rename(file.with_name(f".{file.name}.draft"))
    assert fl.rekey_files(spark, path, target, keyring) == 2
    after = raw_files(f"{target}/a")
    assert all(after[n] == before[n] for n in after if n not in {g.name for g in gone}) and after.keys() == before.keys()
    same(read_table(spark, target, df.schema, keyring, layout="file"), df)
    assert fl.rekey_files(spark, path, target, keyring) == 0


def awkward(seed, n):
    rng = random.Random(seed)
    pieces = ['"', ",", '""', ";", "é", "漢", " ", "x", "\\", "a,b", '"q"', "", "long " * 30]
    return [(k, "".join(rng.choices(pieces, k=rng.randrange(12))), rng.choice([None, "", "v"])) for k in range(n)]


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], str(size))
        spark.conf.set(names[2], "1")

    yield use
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("split", [300, 777, 1024, 4096])
def test_splits_cut_rows_fields_and_characters(spark, keyring, tiny_splits, split):
    df = spark.createDataFrame(awkward(split, 2000), "k int, s string, t string").coalesce(2)
    path = work_path(spark, "files")
    write_table(df, path, keyring, layout="file")
    tiny_splits(split)
    same(fl.read_files(spark, path, keyring, df.schema, whole_bytes=0), df)


def test_rows_longer_than_splits_and_ends(spark, keyring, tiny_splits, monkeypatch):
    monkeypatch.setattr(fl, "EDGE_BYTES", 64)
    monkeypatch.setattr(fl, "SEGMENT_BYTES", 160)
    rows = [(k, "y" * size) for k, size in enumerate([5, 20_000, 1, 900, 0, 3000, 70, 9000, 12, 12_345])]
    df = spark.createDataFrame(rows, "k int, s string").coalesce(1)
    path = work_path(spark, "files")
    write_table(df, path, keyring, layout="file")
    tiny_splits(1000)
    same(fl.read_files(spark, path, keyring, df.schema, whole_bytes=0), df)


def test_no_final_line_break_and_crlf(spark, keyring, tiny_splits):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(3000)], "k int, s string")
    text = "k,s\r\n" + "\r\n".join(f'{k},"v{k}"' for k in range(3000))
    one = spark.createDataFrame([("x.csv.cbc", text)], "name string, text string")
    key = keyring.active_key()
    sealed = one.select("name", fl.encrypt_bytes(F.col("text").cast("binary"), key).alias("content"))
    for head in (b"", fl.file_head(keyring.active_id)):
        path, staged = work_path(spark, "files"), work_path(spark, "staged")
        sealed.withColumn("content", F.concat(F.lit(head), "content")).write.parquet(staged)
        fl.export_files(spark.read.parquet(staged), path)
        tiny_splits(2000)
        same(fl.read_files(spark, path, keyring, df.schema, whole_bytes=0), df)


def test_large_and_small_files_under_two_keys(spark, tiny_splits):
    keyring = new_keyring(spark)
    df, path = table(spark, "/root/testdata/sf0.01", "orders"), work_path(spark, "files")
    write_table(df.where("o_orderkey % 3 = 0").coalesce(1), f"{path}/large", keyring, layout="file")
    keyring = keyring.add_key()
    write_table(df.where("o_orderkey % 3 > 0").repartition(40), f"{path}/small", keyring, layout="file")
    write_table(df.limit(5), f"{path}/plain", crypto_mode=fl_plain())
    tiny_splits(50_000)
    found = fl.read_files(spark, path, keyring, df.schema, whole_bytes=100_000)
    same(found, df)
    only = fl.open_in_splits(spark, path, keyring, df.schema, whole_bytes=100_000)
    assert only.rdd.getNumPartitions() >= 4  # one file, several tasks
    assert only.count() == df.where("o_orderkey % 3 = 0").count()


def fl_plain():
    from sealtable.functions.cipher import PLAIN_TEXT

    return PLAIN_TEXT


def test_shuffled_places_keep_the_order(spark, keyring, tiny_splits, monkeypatch):
    monkeypatch.setattr(fl, "BROADCAST_SPLITS", 3)
    df = table(spark, SF_DIR, "lineitem").coalesce(1)
    path = work_path(spark, "files")
    write_table(df, path, keyring, layout="file")
    tiny_splits(30_000)
    same(fl.read_files(spark, path, keyring, df.schema, whole_bytes=0), df)


def test_wrong_key_and_wrong_table_in_splits(spark, keyring, tiny_splits):
    df, path = table(spark, SF_DIR, "orders").coalesce(1), work_path(spark, "files")
    write_table(df, path, keyring, layout="file")
    tiny_splits(20_000)
    with pytest.raises(Exception, match="header"):
        fl.read_files(spark, path, keyring, df.withColumnRenamed("o_custkey", "other").schema, whole_bytes=0).collect()
    with pytest.raises(Exception, match="header|padding|Malformed|AES_CRYPTO|UTF"):
        fl.read_files(spark, path, new_keyring(spark), df.schema, whole_bytes=0).collect()


def test_staged_files_are_not_compressed(spark, keyring, monkeypatch):
    import pyarrow.parquet as pq

    made = []
    monkeypatch.setattr(fl, "work_path", lambda s, label: made.append(work_path(s, label)) or made[-1])
    df, path = spark.range(3000).repartition(2), work_path(spark, "target")
    fl.write_files(df, path, keyring, file_bytes=2000)
    (staged,) = made
    for part in pathlib.Path(staged.removeprefix("file://")).glob("*.parquet"):
        groups = pq.ParquetFile(part).metadata
        column = groups.row_group(0).column(groups.schema.names.index("content"))
        assert column.compression == "UNCOMPRESSED" and not column.has_dictionary_page
    back = fl.read_files(spark, path, keyring, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


@pytest.mark.parametrize("split", [300, 4096])
def test_splits_carry_the_bytes_before_them(spark, keyring, tiny_splits, split):
    """32 bytes and no list of them, as every line of ciphertext has them beside it."""
    df, path = spark.range(1500).coalesce(1), work_path(spark, "files")
    write_table(df, path, keyring, layout="file")
    (content,) = raw_files(path).values()
    tiny_splits(split)
    summary = fl._summary(fl._parts(spark, path, fl.SEALED_GLOB, 0), 64)
    places = fl._placed(summary, keyring, None).select("at", "carry").collect()
    assert len(places) > 1
    assert all(bytes(p.carry) == content[max(0, p.at - 32) : p.at] for p in places)


def test_lines_lose_their_cr_and_empty_lines_go(spark, keyring, tiny_splits):
    text = "k,s\r\n1,\"a\"\r\n\r\n2,\"b\"\n\n3,\"\"\r\n"
    one = spark.createDataFrame([("x.csv.cbc", text)], "name string, text string")
    path, staged = work_path(spark, "files"), work_path(spark, "staged")
    one.select("name", fl.encrypt_bytes(F.col("text").cast("binary"), keyring.active_key()).alias("content")).write.parquet(staged)
    fl.export_files(spark.read.parquet(staged), path)
    for split in (20, 1000):
        tiny_splits(split)
        rows = fl.read_files(spark, path, keyring, "k int, s string", whole_bytes=0).collect()
        assert sorted(map(tuple, rows)) == [(1, "a"), (2, "b"), (3, "")]
