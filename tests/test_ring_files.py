"""Key ids that never repeat, rings of few files, bounded rows out of many tasks."""

import pathlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sealtable.operators import keyring as kr
from sealtable.operators import ringfiles
from sealtable.operators.keyring import RING_SCHEMA, Keyring
from sealtable.operators.relational import first_rows
from sealtable.operators.ringfiles import RingFiles
from sealtable.plans.secure_queries import new_keyring, stored, table
from sealtable.session import work_path
from sealtable.sources.readers import read_table


def test_two_writers_never_claim_one_id(spark):
    ring = new_keyring(spark)
    rings = [RingFiles(spark, ring.ring_path, RING_SCHEMA) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        claimed = list(pool.map(lambda k: rings[k % 8].claim_id(2, "local", "analytics"), range(40)))
    assert sorted(claimed) == list(range(2, 42))


def test_keys_added_at_once(spark):
    ring = new_keyring(spark)
    again = [Keyring.open(spark, ring.primary_path, ring.ring_path, "analytics") for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda r: r.add_key(), again))
    ids = sorted(r.key_id for r in spark.read.parquet(ring.ring_path).collect())
    assert ids == [1, 2, 3, 4, 5] and ring.reopened().n_keys == 5
    assert {a.active_id for a in added} <= set(ids)


def test_a_ring_of_many_keys_has_few_files(spark, monkeypatch):
    monkeypatch.setattr(kr, "MOST_FILES", 4)
    ring = new_keyring(spark)
    df = table(spark, "/root/testdata/sf0.001", "nation")
    path, old = stored(df, ring), ring
    old.keys.count()
    for _ in range(12):
        ring = ring.add_key()
    files = RingFiles(spark, ring.ring_path, RING_SCHEMA)
    assert len(files.current()) <= 5 and ring.n_keys == 13 and ring.active_id == 13
    assert read_table(spark, path, df.schema, ring).count() == 25
    assert read_table(spark, path, df.schema, ring.reopened()).count() == 25


def test_a_thousand_keys_open_from_few_files(spark):
    """As many files as a thousand additions leave, without running them one by one."""
    ring = new_keyring(spark)
    rows = spark.read.schema(RING_SCHEMA).parquet(ring.ring_path)
    more = rows.withColumn("key_id", F.explode(F.sequence(F.lit(2), F.lit(1000))))
    more.repartition(999, "key_id").write.mode("append").parquet(ring.ring_path)
    files = RingFiles(spark, ring.ring_path, RING_SCHEMA)
    before = len(files.current())
    ring = ring.reopened().add_key()
    assert before > 500 and len(files.current()) == 1
    assert (ring.n_keys, ring.active_id) == (1001, 1001)


def test_compaction_that_stops_changes_nothing(spark, monkeypatch):
    ring = new_keyring(spark)
    for _ in range(3):
        ring = ring.add_key()
    files = RingFiles(spark, ring.ring_path, RING_SCHEMA)
    names = files.current()
    plain = RingFiles._create

    def failing(self, name, text=""):
        if name.endswith("/list"):
            raise RuntimeError("stopped")
        return plain(self, name, text)

    monkeypatch.setattr(RingFiles, "_create", failing)
    with pytest.raises(RuntimeError, match="stopped"):
        files.compact()
    assert files.current() == names and ring.reopened().n_keys == 4
    monkeypatch.setattr(RingFiles, "_create", plain)
    running = ring.reopened()  # a plan over the old files
    assert files.compact() and len(files.current()) == 1 and not files.compact()
    assert running.keys.count() == 4 and ring.reopened().n_keys == 4
    ring.add_key()
    assert files.compact() and ring.reopened().n_keys == 5
    kept = [p.name for p in pathlib.Path(ring.ring_path.removeprefix("file://")).glob("*.parquet")]
    assert not set(kept) & set(names)  # replaced two generations ago: gone


def test_one_application_is_created_once(spark):
    path = work_path(spark, "ring")
    Keyring.create(spark, work_path(spark, "p"), path, "a", shared=True)
    Keyring.create(spark, work_path(spark, "p"), path, "b", shared=True)
    with pytest.raises(ValueError, match="already"):
        Keyring.create(spark, work_path(spark, "p"), path, "a", shared=True)
    assert ringfiles.MOST_FILES > 1


def test_first_rows_out_of_many_tasks(spark):
    df = table(spark, "/root/testdata/sf0.1", "lineitem").repartition(8)
    n = df.count() // 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = first_rows(df, n, "l_orderkey", "l_linenumber", "l_partkey")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) < n / 2
    last = found.agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).first()[0]
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    bound = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in last.asDict().items()])
    assert df.where(order < bound).count() <= n <= df.where(order <= bound).count()
    assert first_rows(df, n, "l_orderkey").count() == n
    assert first_rows(df, 10**9, "l_orderkey").count() == df.count()


def test_first_rows_with_ties_and_clashes(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    found = first_rows(df, 500, "k", "v", at_once=10)
    assert sorted((r.k, r.v) for r in found.collect()) == sorted(((i % 3, i) for i in range(1000)))[:500]
    assert first_rows(df, 500, "k", at_once=10).groupBy("k").count().where("k = 0").first()["count"] == 334
