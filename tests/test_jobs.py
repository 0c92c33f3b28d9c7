"""Jobs, run archive, generated people and layouts."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sealtable.functions import draw
from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT
from sealtable.functions.payload import csv_line
from sealtable.operators.relational import PEOPLE_SCHEMA, count_matching, first_rows, young_developers
from sealtable.plans import jobs, runs, secure_queries
from sealtable.plans.secure_queries import stored, table
from sealtable.session import shared_folder, work_path
from sealtable.sources.blocks import pack_lines
from sealtable.sources.people import people
from sealtable.sources.readers import find_files, gathered, open_files, read_table, scan_sealed
from sealtable.sources.writers import export_files, seal_files, spread, write_table

SF = "/root/testdata/sf0.001"


def test_people_are_the_same_in_any_partitioning(spark):
    one = people(spark, 500, seed=4).coalesce(1).collect()
    seven = spark.range(0, 500, 1, 7)
    from sealtable.sources.people import people_columns

    assert sorted(seven.select(*people_columns(F.col("id"), 4)).collect()) == sorted(one)
    assert sorted(people(spark, 500, seed=5).collect()) != sorted(one)


@pytest.mark.parametrize("portable", [False, True])
def test_people_keep_their_bounds_and_spread(spark, portable):
    from sealtable.sources.people import people_columns

    df = spark.range(30_000).select(*people_columns(F.col("id"), 1, portable)).cache()
    assert df.where("not (name rlike '^[a-z]{3,7}$')").count() == 0
    assert df.agg(F.min("age"), F.max("age")).first() == (18, 60)
    assert {r.job for r in df.select("job").distinct().collect()} == {"Developer", "Engineer", "Researcher"}
    share = count_matching(df, young_developers()).first().n / 30_000
    assert abs(share - 21 / 43 / 3) < 0.01
    assert abs(df.agg(F.corr("age", F.length("name"))).first()[0]) < 0.03


def test_draws(spark):
    df = spark.range(5000).select(
        draw.integer(0, -2, 2, F.col("id"), "x").alias("n"), draw.choice(0, ["a"], F.col("id")).alias("c")
    )
    counts = {r.n: r["count"] for r in df.groupBy("n").count().collect()}
    assert set(counts) == {-2, -1, 0, 1, 2} and min(counts.values()) > 900
    assert df.where("c = 'a'").count() == 5000


def test_the_whole_sample_run(spark, keyring):
    """Generate, store as CSV, encrypt, query encrypted, decrypt; compare with the count made while generating."""
    plain, sealed, found, result = (work_path(spark, n) for n in ("plain", "sealed", "found", "result"))
    sample = people(spark)
    expected = count_matching(sample, young_developers()).first().n
    assert sample.count() == 87 and expected > 0
    write_table(sample, plain, crypto_mode=PLAIN_TEXT, partitions=1)
    jobs.encrypt_table(spark, plain, sealed, PEOPLE_SCHEMA, keyring)
    jobs.query_table(spark, sealed, found, keyring, PEOPLE_SCHEMA)
    jobs.decrypt_table(spark, found, result, PEOPLE_SCHEMA, keyring, input_partitions=8, output_partitions=8)
    rows = read_table(spark, result, PEOPLE_SCHEMA, crypto_mode=PLAIN_TEXT).collect()
    assert len(rows) == expected
    assert all(r.job == "Developer" and 20 <= r.age <= 40 for r in rows)


def test_bounds_of_the_people_query(spark):
    rows = [("a", 19, "Developer"), ("b", 20, "Developer"), ("c", 40, "Developer"), ("d", 41, "Developer"),
            ("e", 30, "developer"), ("f", 30, "Engineer"), ("g", None, "Developer")]
    df = spark.createDataFrame(rows, PEOPLE_SCHEMA)
    assert [r.name for r in df.where(young_developers()).orderBy("name").collect()] == ["b", "c"]
    assert count_matching(df, young_developers()).first().n == 2


@pytest.mark.parametrize("source_mode", [AES_CBC, PLAIN_TEXT])
@pytest.mark.parametrize("target_mode", [AES_CBC, PLAIN_TEXT])
@pytest.mark.parametrize("layout", ["line", "parquet"])
def test_transcode(spark, keyring, source_mode, target_mode, layout):
    df = table(spark, SF, "supplier")
    source, target = work_path(spark, "s"), work_path(spark, "t")
    write_table(df, source, keyring, source_mode, layout=layout)
    jobs.transcode(spark, source, target, df.schema, source_mode, target_mode, keyring, input_layout=layout)
    back = read_table(spark, target, df.schema, keyring, target_mode)
    assert sorted(back.collect()) == sorted(df.collect())


def test_job_refuses_its_own_input_and_existing_output(spark, keyring):
    df = table(spark, SF, "nation")
    path = stored(df, keyring)
    with pytest.raises(ValueError, match="different"):
        jobs.decrypt_table(spark, path, path + "/", df.schema, keyring)
    with pytest.raises(Exception, match="(?i)exists"):
        write_table(df, path, keyring)
    with pytest.raises(ValueError, match="crypto mode"):
        write_table(df, path, keyring, "rot13")
    with pytest.raises(ValueError, match="keyring"):
        write_table(df, path)


def test_partition_counts(spark, keyring):
    df = spark.range(10_000).repartition(4)
    assert gathered(df, 8).rdd.getNumPartitions() == 8
    assert gathered(df, 2).rdd.getNumPartitions() == 2
    assert gathered(df, 4) is df and gathered(df, None) is df
    assert spread(df, 3, 4).rdd.getNumPartitions() == 3
    path = work_path(spark, "eight")
    write_table(df, path, keyring, partitions=8, block_bytes=100)
    assert len(glob.glob(f"{path}/*.txt")) == 8
    assert read_table(spark, path, df.schema, keyring, partitions=3).count() == 10_000


def test_few_read_tasks_get_even_shares(spark, keyring):
    """Five files in four tasks: merging whole files gave one task two of them."""
    df, path = spark.range(20_000), work_path(spark, "five")
    write_table(df, path, keyring, partitions=5, block_bytes=1000)
    tasks = scan_sealed(spark, path, partitions=4).groupBy(F.spark_partition_id()).count().collect()
    blocks = [t["count"] for t in tasks]
    assert len(blocks) == 4 and max(blocks) < 1.2 * sum(blocks) / 4
    assert sorted(read_table(spark, path, df.schema, keyring, partitions=4).collect()) == sorted(df.collect())


def test_eight_files_carry_compressed_blocks(spark, tmp_path, monkeypatch):
    """What the 8 tasks read is well below the lines that they carry, on rows of many kinds."""
    rng = random.Random(5)
    rows = [(rng.randrange(10**9), rng.randrange(10**6), rng.randrange(1, 8), rng.uniform(900, 99_000), rng.choice("ANR"), None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz")
    df = df.withColumn("l_extendedprice", F.round("l_extendedprice", 2)).withColumn("l_shipdate", F.expr("make_timestamp_ntz(1992 + l_partkey % 7, 1 + l_partkey % 12, 1 + l_orderkey % 28, 0, 0, 0)"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {}
    monkeypatch.setattr(secure_queries, "work_path", lambda s, label: made.setdefault(label, work_path(s, label)))
    counts = {r.what: r.n for r in secure_queries.repartition_counts(spark, str(tmp_path)).collect()}
    assert counts == {"tasks_in": 8, "files_out": 8, "rows": 20_000}
    lines = df.select(F.sum(F.octet_length(csv_line(df.schema)) + 1)).first()[0]
    sealed = [os.path.getsize(f) for f in glob.glob(f"{made['sealed'].removeprefix('file://')}/*.txt")]
    assert len(sealed) == 8 and sum(sealed) < 0.9 * lines and max(sealed) < 1.2 * sum(sealed) / 8
    plain = read_table(spark, made["plain"], df.schema, crypto_mode=PLAIN_TEXT)
    assert sorted(plain.collect()) == sorted(df.collect())


def test_blocks_keep_every_line_in_order(spark):
    rng = random.Random(1)
    lines = ["x" * rng.choice([0, 1, 5, 50, 300]) + str(i) for i in range(2000)]
    df = spark.createDataFrame([(s,) for s in lines], "line string").coalesce(1)
    blocks = [r.block for r in pack_lines(df, 100).collect()]
    assert "\n".join(blocks).split("\n") == lines
    assert all(len(b) <= 100 or "\n" not in b for b in blocks)
    assert len(blocks) < len(lines)


# ---- file layout ---------------------------------------------------------


def test_file_layout(spark, keyring):
    df = table(spark, SF, "orders")
    sealed, folder = work_path(spark, "files"), work_path(spark, "folder")
    seal_files(df, keyring, file_bytes=10_000).write.parquet(sealed)
    files = spark.read.parquet(sealed)
    assert files.count() > 5
    assert files.agg(F.max(F.length("content"))).first()[0] < 10_000 + 300
    export_files(files, folder)
    export_files(files, folder)
    (spark.createDataFrame([("not,ciphertext",)], "value string").write.text(f"{folder}/people.csv"))
    names = sorted(glob.glob(f"{folder}/*.csv.cbc"))
    assert len(names) == files.count() and not glob.glob(f"{folder}/.part*")
    back = read_table(spark, folder, df.schema, keyring, layout="file", partitions=3)
    assert sorted(back.collect()) == sorted(df.collect())
    from_sink = open_files(files, keyring, df.schema)
    assert from_sink.exceptAll(df).count() == 0 and from_sink.count() == df.count()
    one = find_files(spark, names[0])
    assert one.count() == 1 and 0 < open_files(one, keyring, df.schema).count() < df.count()


def test_file_layout_through_jobs(spark, keyring):
    df = table(spark, SF, "part")
    files, lines = work_path(spark, "files"), work_path(spark, "lines")
    write_table(df, files, keyring, layout="file", partitions=2)
    with pytest.raises(FileExistsError):
        write_table(df, files, keyring, layout="file")
    jobs.transcode(spark, files, lines, df.schema, AES_CBC, AES_CBC, keyring, input_layout="file")
    assert sorted(read_table(spark, lines, df.schema, keyring).collect()) == sorted(df.collect())


def test_file_layout_refuses_other_tables_and_line_breaks(spark, keyring):
    df = spark.createDataFrame([("a,b", 'q"')], "s string, t string")
    files = seal_files(df, keyring)
    assert open_files(files, keyring, df.schema).first() == ("a,b", 'q"')
    with pytest.raises(Exception, match="header"):
        open_files(files, keyring, "s string, other string").collect()
    with pytest.raises(Exception, match="not representable"):
        seal_files(spark.createDataFrame([("a\nb",)], "s string"), keyring).collect()


# ---- runs ----------------------------------------------------------------


def test_archive_replaces_only_the_runs_given(spark):
    rows = [(1, "/o/spark-application-7"), (2, "/o/spark-application-8"), (3, "/o/stdout"), (4, "/o/spark-application-x-7")]
    df = spark.createDataFrame(rows, "id int, path string")
    target = work_path(spark, "archive")
    runs.archive_runs(df, target, "path")
    runs.archive_runs(df.where("id = 1"), target, "path")
    got = {(r.id, str(r.app_id)) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "7"), (2, "8")}


def test_ciphertext_can_be_archived_without_opening_it(spark, keyring):
    df = table(spark, SF, "part")
    path = stored(df, keyring)
    lines = spark.read.text(path).withColumn("path", F.lit("/o/spark-application-9"))
    target = work_path(spark, "archive")
    runs.archive_runs(lines.select("value", "path"), target, "path")
    kept = spark.read.parquet(target).where("app_id = 9").select("value")
    assert kept.exceptAll(spark.read.text(path)).count() == 0 and kept.count() > 0


def test_text_outputs_of_runs(spark):
    folder, target = work_path(spark, "outputs"), work_path(spark, "archive")
    for run in ("spark-application-11", "spark-application-12", "other"):
        spark.createDataFrame([(run,), ("second line",)], "value string").write.text(f"{folder}/{run}")
    runs.archive_runs(runs.text_outputs(spark, folder), target, "entry")
    got = spark.read.parquet(target).where("value <> 'second line'").select("value", "app_id").collect()
    assert {(r.value, str(r.app_id)) for r in got} == {("spark-application-11", "11"), ("spark-application-12", "12")}


def test_run_log(spark, keyring):
    log = work_path(spark, "log")
    for n in (10, 20):
        target = work_path(spark, "out")
        runs.logged(spark, log, "app", "encrypt", spark.range(n), lambda d, t=target: write_table(d, t, keyring))
        assert scan_sealed(spark, target).count() > 0
    rows = spark.read.parquet(log).orderBy("n_rows").collect()
    assert [r.n_rows for r in rows] == [10, 20]
    assert all(r.finished_at >= r.started_at for r in rows)


def test_first_rows(spark):
    assert [r.id for r in first_rows(spark.range(100).repartition(7), 3, "id").collect()] == [0, 1, 2]


class StubSession:
    """Just the two settings :func:`shared_folder` looks at."""

    def __init__(self, master, folder=None):
        self.folder, self.master, self.applicationId = folder, master, "app-1"

    conf = sparkContext = property(lambda self: self)

    def getConf(self):
        return self

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert shared_folder(StubSession("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(StubSession("yarn"))
    assert shared_folder(StubSession("local[2]")) == shared_folder(StubSession("local[2]"))


# ---- command line ----------------------------------------------------------


def test_command_line(spark, capsys):
    from sealtable.__main__ import main

    keys = ["--primaryKeyPath", work_path(spark, "p"), "--dataKeyPath", work_path(spark, "k"), "--appId", "demo"]
    plain, sealed, found, result, turned, archive, log = (
        work_path(spark, n) for n in ("plain", "sealed", "found", "result", "turned", "archive", "log")
    )
    io = lambda a, b: ["--inputPath", a, "--outputPath", b]
    main(["generate-keys", *keys], spark)
    main(["generate-people", "--outputPath", plain, "--rows", "200", "--outputPartitionNum", "1"], spark)
    assert "20 and 40 is" in capsys.readouterr().out
    main(["encrypt", *keys, *io(plain, sealed)], spark)
    main(["query", *keys, *io(sealed, found), "--runLog", log], spark)
    main(["add-key", *keys], spark)
    main(["rekey", *keys, *io(found, turned)], spark)
    main(["decrypt", *keys, *io(turned, result), "--inputPartitionNum", "8", "--outputPartitionNum", "8",
          "--inputEncryptModeValue", AES_CBC, "--outputEncryptModeValue", PLAIN_TEXT, "--runLog", log], spark)
    expected = people(spark, 200).where(young_developers()).count()
    assert read_table(spark, result, PEOPLE_SCHEMA, crypto_mode=PLAIN_TEXT).count() == expected > 0
    assert {(r.job, r.n_rows) for r in spark.read.parquet(log).collect()} == {("query", expected), ("decrypt", expected)}
    main(["query", *keys, *io(sealed, work_path(spark, "q")), "--where", "age < 30", "--outputEncryptModeValue", PLAIN_TEXT], spark)
