"""Keys, ciphertext and plans."""

import base64
import contextlib
import glob
import io
import os

import pytest
from pyspark.sql import functions as F

from sealtable.operators.keyring import Keyring
from sealtable.plans import jobs
from sealtable.plans.secure_queries import new_keyring, stored, table
from sealtable.session import work_path
from sealtable.sources.readers import open_sealed, read_table, scan_sealed
from sealtable.sources.writers import write_table

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    text = out.getvalue()
    return text[text.index("== Physical Plan ==") :]


@pytest.fixture(scope="module")
def customer(spark):
    return table(spark, SF, "customer")


@pytest.fixture(scope="module")
def sealed_customer(customer, keyring):
    return stored(customer, keyring)


def test_equal_rows_differ_in_ciphertext(spark, keyring):
    path = work_path(spark, "equal")
    write_table(spark.range(100).select(F.lit("same").alias("s")), path, keyring, block_bytes=0)
    assert spark.read.text(path).distinct().count() == 100


def test_one_decryption_of_data_in_a_filtered_read(spark, keyring, customer, sealed_customer):
    df = read_table(spark, sealed_customer, customer.schema, keyring)
    filtered = df.where("c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000").select("c_name")
    # One for the data and one for unwrapping the data key.
    assert plan_of(filtered).count("aesDecrypt") == 2


def test_decryptions_of_a_rekey(spark, customer):
    ring = new_keyring(spark)
    path = stored(customer, ring)
    ring = ring.add_key()
    plan = plan_of(jobs.rekeyed(scan_sealed(spark, path), ring))
    assert plan.split("Subquer")[0].count("aesEncrypt") == 1
    # Data once; key unwrapping for the join and for the active-key subquery.
    assert plan.count("aesDecrypt") == 3


def test_encrypting_and_decrypting_need_no_shuffle(spark, keyring, customer, sealed_customer):
    from sealtable.sources.writers import seal_rows

    for df in (seal_rows(customer, keyring), read_table(spark, sealed_customer, customer.schema, keyring)):
        assert "Exchange hashpartitioning" not in plan_of(df)
        assert "RoundRobin" not in plan_of(df)
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_filter_stays_above_and_scan_reads_ciphertext_only(spark, keyring, customer):
    path = stored(customer, keyring, "parquet")
    plan = plan_of(read_table(spark, path, customer.schema, keyring, layout="parquet").where("c_custkey = 3"))
    assert "ReadSchema: struct<key_id:int,body:binary>" in plan


def test_keys_appear_nowhere(spark, keyring, customer, sealed_customer):
    df = read_table(spark, sealed_customer, customer.schema, keyring).where("c_custkey < 10")
    assert df.count() == 10
    write_table(df, work_path(spark, "again"), keyring)
    keys = [bytes(r.data_key) for r in keyring.keys.collect()]
    keys += [bytes(r.primary_key) for r in spark.read.schema("primary_key binary").json(keyring.primary_path).collect()]
    folder = spark.sparkContext.getConf().get("spark.eventLog.dir").removeprefix("file://")
    log = b"".join(
        open(f, "rb").read() for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f)
    )
    assert len(log) > 100_000
    text = plan_of(df).encode() + log + plan_of(keyring.keys).encode()
    ring = b"".join(open(f, "rb").read() for f in glob.glob(f"{keyring.ring_path}/*.parquet"))
    for key in keys:
        assert key.hex().encode() not in text.lower()
        assert base64.b64encode(key) not in text
        assert key not in text and key not in ring


def test_ciphertext_files_hold_no_plaintext(spark, sealed_customer):
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{sealed_customer}/*.txt"))
    assert len(data) > 1000
    assert b"Customer#" not in data and b"BUILDING" not in data


def test_plain_files_in_the_same_folder_are_not_read(spark, keyring, customer):
    path = stored(customer, keyring)
    customer.write.mode("append").option("header", "true").csv(path)
    assert read_table(spark, path, customer.schema, keyring).count() == customer.count()


# ---- wrong keys and damaged data ---------------------------------------


def test_wrong_primary_key_is_refused_before_data_is_read(spark, keyring):
    other = new_keyring(spark)
    with pytest.raises(ValueError, match="primary key does not open 1 of 1"):
        Keyring.open(spark, other.primary_path, keyring.ring_path, "analytics")


def test_wrong_data_key_never_yields_rows(spark, keyring):
    other = new_keyring(spark)
    path = work_path(spark, "many")
    write_table(spark.range(2000).select(F.col("id").cast("string").alias("s")), path, keyring, block_bytes=0)
    for row in scan_sealed(spark, path).limit(5).collect():
        one = spark.createDataFrame([(row.key_id, row.body)], "key_id int, body binary")
        with pytest.raises(Exception, match="AES_CRYPTO_ERROR|check value differs"):
            open_sealed(one, other, "s string").collect()
    # Each of the 2,000 on its own: undecryptable, or refused by its check value.
    from sealtable.functions.cipher import CHECK_BYTES, check_value

    tried = other.attach(scan_sealed(spark, path)).select(
        F.try_aes_decrypt("body", "data_key", F.lit("CBC"), F.lit("PKCS")).alias("d")
    )
    rest = F.substring("d", CHECK_BYTES + 1, 2**31 - 1)
    assert tried.where(F.substring("d", 1, CHECK_BYTES) == check_value(rest)).count() == 0


@pytest.mark.parametrize("place", [0, 20, 40, -1])
def test_a_flipped_bit_is_found(spark, keyring, place):
    path = work_path(spark, "flip")
    write_table(spark.createDataFrame([("some text to be damaged",)], "s string"), path, keyring)
    row = scan_sealed(spark, path).first()
    body = bytearray(row.body)
    body[place] ^= 1
    damaged = spark.createDataFrame([(row.key_id, body)], "key_id int, body binary")
    with pytest.raises(Exception, match="AES_CRYPTO_ERROR|check value differs"):
        open_sealed(damaged, keyring, "s string").collect()


def test_missing_key_fails_loudly(spark, keyring, customer, sealed_customer):
    foreign = scan_sealed(spark, sealed_customer).withColumn("key_id", F.lit(77))
    with pytest.raises(Exception, match="no data key 77"):
        open_sealed(foreign, keyring, customer.schema).collect()


def test_malformed_sealed_line_fails_loudly(spark, keyring, customer):
    path = stored(customer, keyring)
    spark.createDataFrame([("not a sealed line",)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception, match="no data key"):
        read_table(spark, path, customer.schema, keyring).count()


# ---- keyring -----------------------------------------------------------


def test_keyring_refuses_unknown_provider_and_app(spark, keyring):
    with pytest.raises(ValueError, match="provider"):
        Keyring.open(spark, keyring.primary_path, keyring.ring_path, "analytics", provider="remote")
    with pytest.raises(ValueError, match="no usable data key"):
        Keyring.open(spark, keyring.primary_path, keyring.ring_path, "someone else")


def test_keyring_refuses_repeated_key_ids(spark):
    ring = new_keyring(spark)
    spark.read.parquet(ring.ring_path).write.mode("append").parquet(ring.ring_path)
    with pytest.raises(ValueError, match="repeat"):
        ring.reopened()


@pytest.mark.parametrize("size", [16, 24, 32])
def test_key_sizes(spark, size):
    ring = Keyring.create(spark, work_path(spark, "p"), work_path(spark, "r"), "app", key_bytes=size)
    assert len(ring.keys.first().data_key) == size
    df = spark.createDataFrame([("x",)], "s string")
    assert read_table(spark, stored(df, ring), df.schema, ring).first().s == "x"


def test_bad_key_size(spark):
    with pytest.raises(ValueError, match="16, 24 or 32"):
        Keyring.create(spark, work_path(spark, "p"), work_path(spark, "r"), "app", key_bytes=20)


def test_two_apps_share_the_files_but_not_the_keys(spark, customer):
    first = new_keyring(spark)
    second = Keyring.create(spark, work_path(spark, "primary"), work_path(spark, "ring"), "other")
    both_p, both_r = work_path(spark, "primary"), work_path(spark, "ring")
    for ring in (first, second):
        spark.read.text(ring.primary_path).write.mode("append").text(both_p)
        spark.read.parquet(ring.ring_path).write.mode("append").parquet(both_r)
    path = stored(customer, second)
    opened = Keyring.open(spark, both_p, both_r, "other")
    assert opened.n_keys == 1
    assert read_table(spark, path, customer.schema, opened).count() == customer.count()
    wrong = Keyring.open(spark, both_p, both_r, "analytics")
    with pytest.raises(Exception, match="AES_CRYPTO_ERROR|check value differs"):
        read_table(spark, path, customer.schema, wrong).count()


def test_large_keyring_is_joined_without_broadcast(spark, customer):
    """Beyond the bound the ring is shuffled with salt; most rows lie under one key."""
    ring = new_keyring(spark)
    path = work_path(spark, "sealed")
    write_table(customer, path, ring, block_bytes=0)
    for _ in range(2):
        ring = ring.add_key()
    write_table(customer.limit(5), path, ring, block_bytes=0, save_mode="append")
    big = Keyring.open(spark, ring.primary_path, ring.ring_path, "analytics", broadcast_keys=1)
    df = read_table(spark, path, customer.schema, big)
    plan = plan_of(df)
    assert "Exchange hashpartitioning(key_id" in plan and "_salt" in plan
    assert df.exceptAll(customer).count() == 5
    assert customer.exceptAll(df).count() == 0
    foreign = scan_sealed(spark, path).withColumn("key_id", F.lit(77))
    with pytest.raises(Exception, match="no data key 77"):
        open_sealed(foreign, big, customer.schema).collect()


def test_rotation(spark, customer):
    ring = new_keyring(spark)
    path, half, done = (work_path(spark, n) for n in ("a", "b", "c"))
    write_table(customer, path, ring, block_bytes=0)
    ring = ring.add_key()
    assert ring.n_keys == 2 and ring.active_id != 1
    write_table(customer, path, ring, block_bytes=0, save_mode="append")
    new_lines = spark.read.text(path).where(f"value like '{ring.active_id} %'")
    assert new_lines.count() == customer.count()
    jobs.rekey_table(spark, path, half, ring)
    moved = spark.read.text(half)
    assert moved.where(f"value not like '{ring.active_id} %'").count() == 0
    # What lay under the active key already is passed through unchanged.
    assert moved.join(new_lines, "value", "left_semi").count() == customer.count()
    both = read_table(spark, half, customer.schema, ring)
    assert both.exceptAll(customer.union(customer)).count() == 0 and both.count() == 2 * customer.count()
    rewrapped = ring.rewrap(work_path(spark, "p2"), work_path(spark, "r2"))
    assert rewrapped.active_id == ring.active_id and rewrapped.n_keys == 2
    assert read_table(spark, half, customer.schema, rewrapped).count() == 2 * customer.count()
    jobs.rekey_table(spark, half, done, rewrapped, partitions=3)
    assert read_table(spark, done, customer.schema, rewrapped).count() == 2 * customer.count()


def test_keys_are_not_shown_by_repr(keyring):
    assert "data_key" not in repr(keyring)
