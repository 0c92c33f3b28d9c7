"""Two-level keys: a primary key protects data keys, data keys protect data.

The primary key is a one-row file ``(provider, app_id, primary_key)``; data keys
are rows of a keyring table, stored only in wrapped form.  Both enter a plan by
being read and joined, never as literals.  Adding a key appends a row, and wrapping under
a new primary key writes a new table; no key is ever taken out.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.functions.cipher import bind, check_value, decrypt_bytes, encrypt_bytes
from sealtable.operators.ringfiles import MOST_FILES, RingFiles

PRIMARY_SCHEMA = "provider string, app_id string, primary_key binary"
RING_SCHEMA = (
    "key_id int, provider string, app_id string, wrapped_key binary, kcv binary, created_at timestamp, active boolean"
)

# A keyring row is about 100 bytes, so this many are about 10 MB: safe to copy to
# every executor.  A larger ring is joined by a salted shuffle instead.
BROADCAST_KEYS = 100_000
SALTS = 64


@dataclass(frozen=True)
class Keyring:
    """An opened and verified keyring of one application."""

    spark: SparkSession
    primary_path: str
    ring_path: str
    provider: str
    app_id: str
    n_keys: int
    active_id: int
    broadcast_keys: int = BROADCAST_KEYS

    # ---- making keys ---------------------------------------------------

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        primary_path: str,
        ring_path: str,
        app_id: str,
        provider: str = "local",
        key_bytes: int = 32,
        shared: bool = False,
    ) -> Keyring:
        """Write a new primary key and a keyring holding one data key under it.  With
        ``shared`` the ring may exist and hold the keys of other applications."""
        _check_size(key_bytes)
        _write_primary(spark, primary_path, provider, app_id)
        primary = _read_primary(spark, primary_path, provider, app_id)
        files = RingFiles(spark, ring_path, RING_SCHEMA)
        if not shared and files.exists():
            raise FileExistsError(f"{ring_path} exists already")
        if files.claim_id(1, provider, app_id) != 1:
            raise ValueError(f"{provider}/{app_id} has keys in {ring_path} already")
        _append_key(spark, primary, ring_path, 1, provider, app_id, key_bytes)
        return cls.open(spark, primary_path, ring_path, app_id, provider)

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        primary_path: str,
        ring_path: str,
        app_id: str,
        provider: str = "local",
        broadcast_keys: int = BROADCAST_KEYS,
    ) -> Keyring:
        """Verify every key of the application before any data is read.

        One small job finds a missing or doubled primary key, doubled key ids and a
        primary key that does not belong to the ring, and counts the keys; the count
        is what later decides whether the ring may be broadcast.
        """
        if provider != "local":
            raise ValueError(f"key provider {provider!r} is not available; only 'local' is")
        primary = _read_primary(spark, primary_path, provider, app_id)
        good = F.coalesce(check_value(_unwrapped(safe=True)) == F.col("kcv"), F.lit(False))
        age = F.when(F.col("active"), F.struct("created_at", "key_id"))
        found = (
            _wrapped(spark, primary, ring_path, provider, app_id)
            .agg(
                F.count("*").alias("n"),
                F.count_distinct("key_id").alias("ids"),
                F.count_if(~good).alias("refused"),
                F.max_by("key_id", age).alias("active_id"),
            )
            .first()
        )
        if found.n == 0 or found.active_id is None:
            raise ValueError(f"no usable data key for {provider}/{app_id} in {ring_path}")
        if found.ids != found.n:
            ring = _own_rows(_read_ring(spark, ring_path), provider, app_id)
            twice = ring.groupBy("key_id").count().where("count > 1").orderBy("key_id").limit(10)
            ids = ", ".join(str(r.key_id) for r in twice.collect())
            raise ValueError(f"key ids repeat in {ring_path} ({ids}), or the primary key does in {primary_path}")
        if found.refused:
            raise ValueError(f"primary key does not open {found.refused} of {found.n} data keys")
        return cls(spark, primary_path, ring_path, provider, app_id, found.n, found.active_id, broadcast_keys)

    def add_key(self, key_bytes: int = 32) -> Keyring:
        """Append a data key; it becomes the active one, older ones keep opening old data.

        Its id is the next one that no other writer has claimed, also of two who add keys
        at once.  Now and then the files of the ring are written as one.
        """
        _check_size(key_bytes)
        files = RingFiles(self.spark, self.ring_path, RING_SCHEMA)
        largest = self._ring().agg(F.max("key_id")).first()[0]
        new = files.claim_id(largest + 1, self.provider, self.app_id)
        primary = _read_primary(self.spark, self.primary_path, self.provider, self.app_id)
        _append_key(
            self.spark, primary, self.ring_path, new, self.provider, self.app_id, key_bytes
        )
        if len(files.current()) > MOST_FILES:
            files.compact()
        return self.reopened()

    def reopened(self) -> Keyring:
        return Keyring.open(
            self.spark, self.primary_path, self.ring_path, self.app_id, self.provider, self.broadcast_keys
        )

    def rewrap(self, new_primary_path: str, new_ring_path: str) -> Keyring:
        """Change the primary key.  Touches only the keyring, no data."""
        _write_primary(self.spark, new_primary_path, self.provider, self.app_id)
        fresh = _read_primary(self.spark, new_primary_path, self.provider, self.app_id)
        kept = self._ring().select("key_id", "provider", "app_id", "kcv", "created_at", "active")
        (
            kept.join(self.keys, "key_id")
            .join(fresh, ["provider", "app_id"])
            .withColumn("wrapped_key", encrypt_bytes(F.col("data_key"), F.col("primary_key")))
            .select(*_ring_columns())
            .write.mode("errorifexists")
            .parquet(new_ring_path)
        )
        return replace(self, primary_path=new_primary_path, ring_path=new_ring_path).reopened()

    # ---- using keys ----------------------------------------------------

    @cached_property
    def keys(self) -> DataFrame:
        """``(key_id, data_key)``, unwrapped inside the plan and checked against ``kcv``.

        The plan is made once, over the key files that were there then.
        """
        primary = _read_primary(self.spark, self.primary_path, self.provider, self.app_id)
        refused = F.raise_error(F.lit("key check value differs")).cast("binary")
        verified = bind(_unwrapped(), lambda k: F.when(check_value(k) == F.col("kcv"), k).otherwise(refused))
        return _wrapped(self.spark, primary, self.ring_path, self.provider, self.app_id).select(
            "key_id", verified.alias("data_key")
        )

    def active_key(self) -> Column:
        """The key for new data, as a one-value subquery, so that no join is needed to encrypt."""
        key = self.keys.where(F.col("key_id") == self.active_id).select("data_key").scalar()
        return F.coalesce(key, F.raise_error(F.lit("active data key is gone")).cast("binary"))

    def attach(self, sealed: DataFrame) -> DataFrame:
        """Add ``data_key`` to rows of ``(key_id, body)``; a key that is missing fails the job."""
        if self.n_keys <= self.broadcast_keys:
            joined = sealed.join(F.broadcast(self.keys), "key_id", "left")
        else:
            # Most rows may share one key, so the row's own bytes spread them.
            salted = sealed.withColumn("_salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)))
            copies = self.keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
            joined = salted.join(copies.hint("shuffle_hash"), ["key_id", "_salt"], "left").drop("_salt")
        missing = F.raise_error(F.concat(F.lit("no data key "), F.coalesce(F.col("key_id").cast("string"), F.lit("?"))))
        return joined.withColumn("data_key", F.coalesce("data_key", missing.cast("binary")))

    def _ring(self) -> DataFrame:
        return _own_rows(_read_ring(self.spark, self.ring_path), self.provider, self.app_id)


def _ring_columns() -> list[str]:
    return [part.split()[0] for part in RING_SCHEMA.split(", ")]


def _own_rows(df: DataFrame, provider: str, app_id: str) -> DataFrame:
    return df.where((F.col("provider") == provider) & (F.col("app_id") == app_id))


def _read_ring(spark: SparkSession, ring_path: str) -> DataFrame:
    return RingFiles(spark, ring_path, RING_SCHEMA).read()


def _read_primary(spark: SparkSession, path: str, provider: str, app_id: str) -> DataFrame:
    return _own_rows(spark.read.schema(PRIMARY_SCHEMA).json(path), provider, app_id)


def _write_primary(spark: SparkSession, path: str, provider: str, app_id: str) -> None:
    row = [(provider, app_id, bytearray(secrets.token_bytes(32)))]
    spark.createDataFrame(row, PRIMARY_SCHEMA).coalesce(1).write.mode("errorifexists").json(path)


def _wrapped(spark: SparkSession, primary: DataFrame, ring_path: str, provider: str, app_id: str) -> DataFrame:
    """Keyring rows beside their primary key, a single row that Spark broadcasts by its file size."""
    ring = _own_rows(_read_ring(spark, ring_path), provider, app_id)
    return ring.join(primary, ["provider", "app_id"])


def _unwrapped(safe: bool = False) -> Column:
    wrapped, primary = F.col("wrapped_key"), F.col("primary_key")
    if safe:
        return F.try_aes_decrypt(wrapped, primary, F.lit("CBC"), F.lit("PKCS"))
    return decrypt_bytes(wrapped, primary)


def _check_size(key_bytes: int) -> None:
    if key_bytes not in (16, 24, 32):
        raise ValueError("a data key has 16, 24 or 32 bytes")


def _append_key(
    spark: SparkSession, primary: DataFrame, ring_path: str, key_id: int, provider: str, app_id: str,
    key_bytes: int,
) -> None:
    fresh = spark.createDataFrame(
        [(key_id, provider, app_id, bytearray(secrets.token_bytes(key_bytes)))],
        "key_id int, provider string, app_id string, data_key binary",
    )
    row = (
        fresh.join(primary, ["provider", "app_id"])
        .withColumn("wrapped_key", encrypt_bytes(F.col("data_key"), F.col("primary_key")))
        .withColumn("kcv", check_value(F.col("data_key")))
        .withColumn("created_at", F.current_timestamp())
        .withColumn("active", F.lit(True))
        .select(*_ring_columns())
    )
    RingFiles(spark, ring_path, RING_SCHEMA).add(row)
