"""Archiving a whole run: its result, event log, printed lines and hidden files.

A run's files are copied below the archive, each attempt into a folder of its own, and
listed in a manifest: kind, name, bytes, lines and SHA-256 of each.  The manifest is written
last, as one file, which is the commit: until then readers see the run as it was archived
before, or not at all.  Files are copied as streams, one row of a table each, so large files
take no memory; ciphertext stays ciphertext and is read from the archive like any table.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT
from sealtable.operators.keyring import Keyring
from sealtable.plans.runs import RUN_GLOB, logged
from sealtable.session import work_path
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_table

EVENT_LOG, RESULT, STDOUT, HIDDEN = "event log", "result", "stdout", "hidden"
TEXT_KINDS = (EVENT_LOG, STDOUT)
MANIFEST_SCHEMA = (
    "run_id string, attempt string, committed_at timestamp, kind string, name string, path string, "
    "bytes bigint, lines bigint, sha256 string"
)
CHUNK = 8 * 1024 * 1024


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def run_of(names: Sequence[str], glob: str = RUN_GLOB) -> str:
    """The id of the one run whose event log is among these top-level names."""
    tops = sorted({n.split("/")[0] for n in names if fnmatch.fnmatchcase(n.split("/")[0], glob)})
    if len(tops) != 1:
        raise ValueError(f"expected the event log of one run, found {tops}")
    return tops[0].rpartition("-")[2]


def kind_of(name: str, stdout: str, glob: str = RUN_GLOB) -> str:
    top = name.split("/")[0]
    if any(part.startswith(".") for part in name.split("/")):
        return HIDDEN
    if fnmatch.fnmatchcase(top, glob):
        return EVENT_LOG
    return STDOUT if top == stdout else RESULT


def outputs_of(folder: str, stdout: str, glob: str = RUN_GLOB) -> list[tuple[str, str, int]]:
    """``(name, kind, bytes)`` of every file below a run's folder, hidden ones included.  Spark's
    own sources leave those out, hence the file system is asked."""
    from pyarrow import fs

    store, root = _store(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    names = [(f.path[len(root.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
    return [(n, kind_of(n, stdout, glob), size) for n, size in sorted(names)]


def _copied(files: DataFrame, source: str, target: str) -> DataFrame:
    """Copy each ``(name, kind, bytes)`` and describe what was written."""

    def copy(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        store, root = _store(source)
        to_store, to_root = _store(target)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                digest, lines, size, last = hashlib.sha256(), 0, 0, b"\n"
                path = f"{to_root}/{row['name']}"
                folder, _, leaf = path.rpartition("/")
                to_store.create_dir(folder, recursive=True)
                draft = f"{folder}/{leaf}.{uuid.uuid4().hex}.draft"
                with store.open_input_stream(f"{root}/{row['name']}") as read, to_store.open_output_stream(draft) as write:
                    while chunk := read.read(CHUNK):
                        write.write(chunk)
                        digest.update(chunk)
                        lines, size, last = lines + chunk.count(b"\n"), size + len(chunk), chunk[-1:]
                if size != row["bytes"]:
                    raise ValueError(f"{row['name']} changed while it was archived")
                to_store.move(draft, path)
                out.append((row["name"], row["kind"], f"{target}/{row['name']}", size, lines + (last != b"\n"), digest.hexdigest()))
            names = ["name", "kind", "path", "bytes", "lines", "sha256"]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return files.mapInArrow(copy, "name string, kind string, path string, bytes bigint, lines bigint, sha256 string")


def archive_run(
    spark: SparkSession, outputs: str, archive: str, stdout: str = "job-stdout", glob: str = RUN_GLOB, tasks: int = 64
) -> str:
    """Archive everything below ``outputs`` under the id of its run, which is returned.

    Archiving a run again replaces it as a whole; if that fails, what was there stays.
    """
    found = outputs_of(outputs, stdout, glob)
    run_id, attempt = run_of([n for n, _, _ in found], glob), uuid.uuid4().hex
    target = f"{archive}/files/{run_id}/{attempt}"
    # Large files first, dealt in turn, so that no task gets several of the largest.
    tasks = min(tasks, len(found))
    listed = [(*f, k % tasks) for k, f in enumerate(sorted(found, key=lambda f: -f[2]))]
    files = spark.createDataFrame(listed, "name string, kind string, bytes bigint, task int")
    dealt = files.repartitionById(tasks, "task").select("name", "kind", "bytes")
    noted = work_path(spark, "manifest")
    _copied(dealt, outputs, target).write.parquet(noted)
    described = spark.read.parquet(noted)
    if described.count() != len(found):
        raise RuntimeError("not all files of the run were copied")
    rows = described.select(
        F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), F.lit(dt.datetime.now(dt.UTC)).alias("committed_at"),
        "kind", "name", "path", "bytes", "lines", "sha256",
    )
    rows.coalesce(1).write.mode("append").parquet(f"{archive}/manifest")
    return run_id


def manifest(spark: SparkSession, archive: str) -> DataFrame:
    """The files of every run as last archived."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{archive}/manifest")
    last = rows.groupBy("run_id").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    return rows.join(last, ["run_id", "attempt"], "left_semi")


def run_folder(spark: SparkSession, archive: str, run_id: str) -> str:
    """Where the files of a run are as last archived."""
    row = manifest(spark, archive).where(F.col("run_id") == run_id).select("attempt").first()
    if row is None:
        raise ValueError(f"run {run_id} is not archived")
    return f"{archive}/files/{run_id}/{row.attempt}"


def archived_lines(spark: SparkSession, archive: str, kinds: Sequence[str] = (*TEXT_KINDS, HIDDEN)) -> DataFrame:
    """``(run_id, kind, name, line_no, line)`` of archived text, lines numbered from 0 in each
    file.  A file is read as a stream; bytes that are no UTF-8 are shown as U+FFFD."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["run_id", "kind", "name", "line_no", "line"]
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                fixed, at, rest = [row[n] for n in names[:3]], 0, b""
                with store.open_input_stream(path) as stream:
                    while True:
                        chunk = stream.read(CHUNK)
                        pieces = (rest + chunk).split(b"\n")
                        # Without more to come, what follows the last LF is a line if not empty.
                        rest = pieces.pop() if chunk else b""
                        if not chunk and pieces[-1] == b"":
                            pieces.pop()
                        for k in range(0, len(pieces), 10_000):
                            some = [p.decode("utf-8", "replace") for p in pieces[k : k + 10_000]]
                            n = len(some)
                            numbers = pa.array(range(at, at + n), pa.int64())
                            yield pa.RecordBatch.from_arrays([*[pa.array([v] * n, pa.string()) for v in fixed], numbers, pa.array(some)], names)
                            at += n
                        if not chunk:
                            break

    files = manifest(spark, archive).where(F.col("kind").isin(*kinds)).select("run_id", "kind", "name", "path")
    return files.repartition("path").mapInArrow(read, "run_id string, kind string, name string, line_no bigint, line string")


def damaged(spark: SparkSession, archive: str) -> DataFrame:
    """``(run_id, name, found)``: archived files whose digest is no longer that of the manifest;
    ``found`` is null for a file that is gone."""

    def check(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                digest = hashlib.sha256()
                try:
                    with store.open_input_stream(path) as stream:
                        while chunk := stream.read(CHUNK):
                            digest.update(chunk)
                    found = digest.hexdigest()
                except FileNotFoundError:
                    found = None
                if found != row["sha256"]:
                    out.append((row["run_id"], row["name"], found))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["run_id", "name", "found"])

    files = manifest(spark, archive).select("run_id", "name", "path", "sha256")
    return files.repartition("path").mapInArrow(check, "run_id string, name string, found string")


def archive_and_decrypt(
    spark: SparkSession,
    outputs: str,
    archive: str,
    plain: str,
    keyring: Keyring,
    schema: T.StructType | str,
    layout: str = "file",
    stdout: str = "job-stdout",
    log: str | None = None,
    partitions: int | None = None,
) -> str:
    """Archive a run, find its ciphertext there, decrypt it to ``plain/<run>`` and log that."""
    run_id = archive_run(spark, outputs, archive, stdout)
    rows = read_table(spark, run_folder(spark, archive, run_id), schema, keyring, AES_CBC, layout, partitions=partitions)

    def write(df: DataFrame) -> None:
        write_table(df, f"{plain}/{run_id}", crypto_mode=PLAIN_TEXT, partitions=partitions, have_partitions=partitions, save_mode="overwrite")

    logged(spark, log or f"{archive}/log", run_id, "decrypt", rows, write)
    return run_id
