"""Encryption and decryption as Column expressions.

Keys reach these functions as columns.  A key given as a literal would be printed
by ``explain()`` and stored in the event log.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two crypto modes a job can be given.
AES_CBC = "AES/CBC/PKCS5Padding"
PLAIN_TEXT = "plain_text"

CHECK_BYTES = 8

# Fixed value: how a zstd frame begins.  No payload line begins like that.
ZSTD_MAGIC = "28B52FFD"


def check_value(data: Column) -> Column:
    """First bytes of the SHA-256 digest, used to refuse a wrong key or damaged bytes."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 2 * CHECK_BYTES))


def encrypt_bytes(data: Column, key: Column) -> Column:
    """AES-CBC with a fresh random IV per value; the IV leads the result."""
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def decrypt_bytes(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def seal(block: Column, key: Column) -> Column:
    """Encrypt a string or bytes together with their check value."""
    data = block.cast("binary")
    return encrypt_bytes(F.concat(check_value(data), data), key)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Catalyst would otherwise copy an expensive expression into every place that
    refers to it; a lambda variable cannot be copied.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _checked(data: Column) -> Column:
    block = F.substring(data, CHECK_BYTES + 1, 2**31 - 1)
    found = F.substring(data, 1, CHECK_BYTES)
    return F.when(found == check_value(block), block).otherwise(
        F.raise_error(F.lit("check value differs: wrong key or damaged data")).cast("binary")
    )


def unseal(body: Column, key: Column) -> Column:
    """Inverse of :func:`seal`, as bytes; fails the job when the check value differs."""
    return bind(decrypt_bytes(body, key), _checked)


def _as_text(block: Column) -> Column:
    packed = F.substring(block, 1, len(ZSTD_MAGIC) // 2) == F.unhex(F.lit(ZSTD_MAGIC))
    wrong = F.raise_error(F.lit("this table is compressed: read it with codec='zstd'")).cast("string")
    return F.when(packed, wrong).otherwise(block.cast("string"))


def marked(block: Column, mark: bytes) -> Column:
    """A block's bytes behind the mark of the schema they were written with."""
    return F.concat(F.lit(mark), block.cast("binary"))


def unseal_marked(body: Column, key: Column, mark: bytes) -> Column:
    """A marked block without its mark; another mark fails the job, so that a table is not
    read with the names or types of another one."""
    other = F.raise_error(F.lit("block was written with another schema or format")).cast("binary")

    def opened(data: Column) -> Column:
        rest = F.substring(data, len(mark) + 1, 2**31 - 1)
        return F.when(F.substring(data, 1, len(mark)) == F.lit(mark), rest).otherwise(other)

    return bind(unseal(body, key), opened)


def unseal_text(body: Column, key: Column, mark: bytes) -> Column:
    """The same as text; compressed blocks are refused rather than misread."""
    return bind(unseal_marked(body, key, mark), _as_text)


def no_newlines(encoded: Column) -> Column:
    """Spark's ``base64`` may wrap at 76 characters; a text row must be one line."""
    return F.replace(encoded, F.lit("\r\n"), F.lit(""))
