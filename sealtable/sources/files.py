"""The file layout: whole CSV files with header, one ciphertext each, for exchange.

A file begins with a mark and the id of its key, then the IV, then the ciphertext.  A file
without the mark, from elsewhere, is IV and ciphertext only, and its key has to be told.

Small files are opened whole, one value each.  Larger ones are read in splits: CBC decrypts
any stretch of blocks if the block before it is known, so each task decrypts what lies in
its own part of the file, whatever part that is.  Spark's text source hands the parts out:
ciphertext is read as lines, that is cut at the byte LF, and comes back by joining them.
How many bytes the parts before hold, and how they end, is known after one pass that keeps
a few bytes of each part; the next pass decrypts.  Rows that lie across parts are put
together from the decrypted ends of these.  No file has to be a value or a task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions import payload
from sealtable.functions.cipher import bind, decrypt_bytes, encrypt_bytes
from sealtable.operators.keyring import Keyring
from sealtable.session import work_path
from sealtable.sources.blocks import pack_lines
from sealtable.sources.tasks import gathered

SEALED_GLOB = "*.csv.cbc"
FILE_BYTES = 64 * 1024 * 1024
# Larger files are read in splits.
WHOLE_BYTES = 2 * FILE_BYTES

# Fixed value: how a file begins that names its key, in eight more bytes.
MARK = b"SEALFILE"
HEAD_BYTES = 16

# What is kept of both ends of a split to put rows across splits together; more is taken
# when a row needs it.
EDGE_BYTES = 64 * 1024
SEGMENT_BYTES = 1024 * 1024
# Splits whose places may be sent to every task; beyond, the parts are shuffled to them.
BROADCAST_SPLITS = 100_000


def file_head(key_id: int) -> bytes:
    return MARK + key_id.to_bytes(8, "big")


def _key_id(head: Column, told: int) -> Column:
    """The key a file names, or the one that was told for files which name none."""
    named = F.conv(F.hex(F.substring(head, len(MARK) + 1, 8)), 16, 10).cast("int")
    return F.when(_marked(head), named).otherwise(F.lit(told))


def _marked(head: Column) -> Column:
    return F.coalesce(F.substring(head, 1, len(MARK)) == F.lit(MARK), F.lit(False))


def find_files(spark: SparkSession, path: str, glob: str = SEALED_GLOB) -> DataFrame:
    """``(path, length, content)`` of every matching file below ``path``; content is read only if used."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def named_files(files: DataFrame, keyring: Keyring, key_id: int | None = None) -> DataFrame:
    """Files with ``key_id`` and ``body``, which is IV and ciphertext."""
    told = keyring.active_id if key_id is None else key_id
    content = F.col("content")
    body = F.when(_marked(content), F.substring(content, HEAD_BYTES + 1, 2**31 - 1)).otherwise(content)
    return files.withColumn("key_id", _key_id(content, told)).withColumn("body", body).drop("content")


def open_files(files: DataFrame, keyring: Keyring, schema: T.StructType | str, key_id: int | None = None) -> DataFrame:
    """Rows of whole-file ciphertexts in column ``content``: header dropped, the rest parsed.
    ``key_id`` is that of files which do not name theirs."""
    schema = payload.as_schema(schema)
    sealed = named_files(files, keyring, key_id).select("key_id", "body")
    text = decrypt_bytes(F.col("body"), F.col("data_key")).cast("string")
    rows = F.split(bind(text, _checked_header(schema)), "\r?\n")
    numbered = keyring.attach(sealed).select(F.posexplode(rows).alias("n", "line"))
    lines = numbered.where("n > 0 and line <> ''").select("line")
    return payload.decode(lines, schema, "csv", escape=False)


def _checked_header(schema: T.StructType):
    """A wrong key that happens to decrypt yields no header; so does a file of another table."""
    header = payload.csv_header(schema)
    other = F.raise_error(F.lit("file does not start with the header of this table")).cast("string")
    return lambda t: F.when(F.regexp_extract(t, "^[^\r\n]*", 0) == header, t).otherwise(other)


def read_files(
    spark: SparkSession,
    path: str,
    keyring: Keyring,
    schema: T.StructType | str,
    key_id: int | None = None,
    partitions: int | None = None,
    glob: str = SEALED_GLOB,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """All rows of the matching files, each under the key it names; large files in splits."""
    schema = payload.as_schema(schema)
    found = find_files(spark, path, glob)
    small = open_files(gathered(found.where(F.col("length") <= whole_bytes), partitions), keyring, schema, key_id)
    if found.where(F.col("length") > whole_bytes).select("path").isEmpty():
        return small
    return small.unionByName(open_in_splits(spark, path, keyring, schema, key_id, glob, whole_bytes))


# ---- reading in splits ---------------------------------------------------


def _parts(spark: SparkSession, path: str, glob: str, whole_bytes: int) -> DataFrame:
    """``(path, start, length, bytes)``: the ciphertext of large files, cut at each LF, which is
    left out; rows of one split come in order, in one task."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n")
    large = reader.text(path).where(F.col("_metadata.file_size") > whole_bytes)
    return large.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("length"),
        F.col("value").cast("binary").alias("bytes"),
    )


def _by_split(batches: Iterator, first: int = 0) -> Iterator[tuple]:
    """``(batch, from, to, is new)`` for each stretch of rows that belong to one split; its
    path and start are columns ``first`` and ``first + 1``."""
    import numpy as np

    seen = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # Starts differ between neighbouring splits of a file, paths between files.
        starts = batch.column(first + 1).to_numpy()
        paths = batch.column(first).dictionary_encode().indices.to_numpy()
        cuts = (np.flatnonzero((np.diff(starts) != 0) | (np.diff(paths) != 0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            split = (batch.column(first)[a].as_py(), int(starts[a]))
            yield batch, a, b, split != seen
            seen = split


def _joined(column, a: int, b: int) -> bytes:
    """The bytes of these rows, with the LF that each ended in."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = column.slice(a, b - a).cast(pa.large_binary())
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(rows)], pa.int64()), rows)
    return pc.binary_join(whole, pa.scalar(b"\n", pa.large_binary()))[0].as_py() + b"\n"


def _summary(parts: DataFrame, edge: int) -> DataFrame:
    """Per split its bytes ``n`` and the first and last ``edge`` of them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["path", "start", "length", "n", "head", "tail"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        state: list | None = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(state, kinds)], names)

        for batch, a, b, new in _by_split(batches):
            if new:
                if state:
                    yield row()
                state = [*(batch.column(c)[a].as_py() for c in range(3)), 0, b"", b""]
            data = _joined(batch.column(3), a, b)
            state[3] += len(data)
            if len(state[4]) < edge:
                state[4] = (state[4] + data)[:edge]
            state[5] = (state[5] + data)[-edge:]
        if state:
            yield row()

    return parts.mapInArrow(run, "path string, start long, length long, n long, head binary, tail binary")


def _placed(summary: DataFrame, keyring: Keyring, key_id: int | None) -> DataFrame:
    """Splits with their place in the file: ``at`` to ``end`` are the bytes read by it, ``data``
    is where the IV stands, ``carry`` the 32 bytes before ``at``; and the file's key.  Of the
    ends of splits only a few bytes go through the running sum of a file."""
    told = keyring.active_id if key_id is None else key_id
    narrow = summary.select(
        "path", "start", "length", "n",
        F.substring("head", 1, HEAD_BYTES).alias("begin"), F.substring("tail", -33, 33).alias("last"),
    )
    order = Window.partitionBy("path").orderBy("start")
    before, earlier = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(-33, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begin = F.first("begin").over(every)
    # A file whose last byte is no LF seems to have one more.
    extra = F.sum("n").over(every) - F.col("length")
    wrong = F.raise_error(F.concat(F.lit("the parts of a file are not the whole of it: "), F.col("path")))
    carry = F.aggregate(F.collect_list("last").over(earlier), F.lit(b""), lambda found, last: F.concat(found, last))
    placed = narrow.select(
        "path", "start", "length", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"),
        F.substring(carry, -32, 32).alias("carry"),
        F.when(extra.isin(0, 1), F.when(_marked(begin), HEAD_BYTES).otherwise(0)).otherwise(wrong.cast("int")).alias("data"),
        _key_id(begin, told).alias("key_id"),
    )
    placed = placed.withColumn("end", F.least(F.col("at") + F.col("n"), "length"))
    # Each task gets the key with its split, so rows keep their order afterwards.
    return keyring.attach(placed.withColumn("body", F.lit(b""))).drop("body")


def _with_ends(splits: DataFrame, summary: DataFrame) -> DataFrame:
    """Splits with their first and last bytes, the imaginary LF at a file's end left out."""
    found = splits.join(summary.select("path", "start", "head", "tail"), ["path", "start"])
    beyond = F.col("at") + F.col("n") > F.col("length")
    shorter = F.substr(F.col("tail"), F.lit(1), F.octet_length("tail") - 1)
    return found.withColumn("tail", F.when(beyond, shorter).otherwise(F.col("tail")))


def _owned(at: int, end: int, data: int) -> tuple[int, int]:
    """The blocks that end after ``at`` and up to ``end``, as the bytes they stand at."""
    first = data + 16
    return first + max(0, at - first) // 16 * 16, first + max(0, end - first) // 16 * 16


def _decrypted(iv_and_body: Column, last: Column, key: Column) -> Column:
    """Whole blocks from anywhere in a CBC ciphertext.  Spark wants padding at the end, so a
    block is added that decrypts to nothing but that: the encryption of the last block after
    XOR with sixteen times 16, which ``last`` is."""
    closing = F.substring(F.aes_encrypt(last, key, F.lit("ECB"), F.lit("PKCS")), 1, 16)
    return decrypt_bytes(F.concat(iv_and_body, closing), key)


def _closing(body: bytes) -> bytes:
    return bytes(x ^ 16 for x in body[-16:])


def _unpadded(plain: bytes) -> bytes:
    pad = plain[-1] if plain else 0
    if not 1 <= pad <= 16 or plain[-pad:] != bytes([pad]) * pad:
        raise ValueError("a file does not end in padding: wrong key or damaged data")
    return plain[:-pad]


SEGMENT = "path string, start long, first boolean, last boolean, kind string, body binary, closing binary, data_key binary"


def _segment(path: str, start: int, first: bool, last: bool, kind: str, body: bytes, key: bytes):
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    row = (path, start, first, last, kind, body, _closing(body), key)
    names = ["path", "start", "first", "last", "kind", "body", "closing", "data_key"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)


def _stretches(parts: DataFrame, splits: DataFrame) -> DataFrame:
    """All ciphertext of the splits as segments, in order; the last segment of a split is of
    kind ``end``, so every split has one."""
    wanted = ["at", "end", "data", "length", "carry", "data_key"]
    placed = splits.select("path", "start", *wanted)
    parts = parts.drop("length")
    if splits.select("path").limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        rows = parts.join(F.broadcast(placed), ["path", "start"])
    else:
        numbered = parts.withColumn("seq", F.monotonically_increasing_id())
        rows = numbered.join(placed, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "seq")

    def run(batches: Iterator) -> Iterator:
        split: tuple | None = None
        held, place = bytearray(), 0

        def cut(whole: bool) -> Iterator:
            """Segments of what is held; ``whole`` at the end of the split."""
            nonlocal place
            path, start, at, end, data, length, key, until = split
            while len(held) - 16 > SEGMENT_BYTES and place + SEGMENT_BYTES < until:
                yield _segment(path, start, at == 0, end == length, "body", bytes(held[: 16 + SEGMENT_BYTES]), key)
                del held[:SEGMENT_BYTES]
                place += SEGMENT_BYTES
            if whole and until > place:
                yield _segment(path, start, at == 0, end == length, "end", bytes(held[: 16 + until - place]), key)

        for batch, a, b, new in _by_split(batches):
            if new:
                if split:
                    yield from cut(True)
                path, start, at, end, data, length = (batch.column(n)[a].as_py() for n in ("path", "start", "at", "end", "data", "length"))
                first, until = _owned(at, end, data)
                split = (path, start, at, end, data, length, batch.column("data_key")[a].as_py(), until)
                before = batch.column("carry")[a].as_py()
                place = first
                # What is held begins one block before the first owned one.
                held = bytearray(before[len(before) - max(0, at - (first - 16)) :] if at > first - 16 else b"")
                skip = max(0, first - 16 - at)
            data_bytes = _joined(batch.column("bytes"), a, b)
            taken = min(skip, len(data_bytes))
            skip -= taken
            held += data_bytes[taken:]
            yield from cut(False)
        if split:
            yield from cut(True)

    return rows.select("path", "start", "bytes", *wanted).mapInArrow(run, SEGMENT)


def _inner_lines(segments: DataFrame, header: str) -> DataFrame:
    """The lines that lie within one split, without the header line of each file."""
    plain = segments.select(
        "path", "start", "first", "last", "kind", _decrypted(F.col("body"), F.col("closing"), F.col("data_key")).alias("plain")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        rest, begun = b"", False
        for batch in batches:
            for row in batch.to_pylist():
                data = rest + (_unpadded(row["plain"]) if row["last"] and row["kind"] == "end" else row["plain"])
                if not begun:
                    # Before the first LF stands the end of a row of the split before, or the header.
                    at = data.find(b"\n")
                    begun = at >= 0
                    if begun and row["first"] and data[:at].rstrip(b"\r") != header.encode():
                        raise ValueError("file does not start with the header of this table")
                    data = data[at + 1 :] if begun else data if row["first"] else b""
                last = data.rfind(b"\n") if begun else -1
                if last >= 0:
                    text = pa.array([data[:last]], pa.large_binary()).cast(pa.large_string())
                    lines = pc.split_pattern(text, "\n").flatten().cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lines], ["line"])
                rest = data[last + 1 :]
                if row["kind"] == "end":
                    if row["first"] and not begun:
                        raise ValueError("the header of a file is longer than its first part")
                    rest, begun = b"", False

    return plain.mapInArrow(run, "line string")


def _edges(splits: DataFrame) -> DataFrame:
    """Both ends of each split as segments of kind ``head`` and ``tail``, or ``all`` of it."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                at, end, data, key = row["at"], row["end"], row["data"], row["data_key"]
                first, until = _owned(at, end, data)
                if until <= first:
                    continue
                fixed = (row["path"], row["start"], at == 0, end == row["length"])
                before = row["carry"]
                # Two stretches of the file that are known; they may meet.
                known = [(at - len(before), before + row["head"]), (end - len(row["tail"]), row["tail"])]
                if known[1][0] <= known[0][0] + len(known[0][1]):
                    place, head = known[0]
                    whole = head + row["tail"][place + len(head) - known[1][0] :]
                    body = whole[first - 16 - place : until - place]
                    yield _segment(*fixed, "all", body, key)
                    continue
                if at > 0:
                    place, head = known[0]
                    upto = (place + len(head) - first) // 16 * 16
                    yield _segment(*fixed, "head", head[first - 16 - place : first - place + upto], key)
                place, tail = known[1]
                since = first + -(-(place + 16 - first) // 16) * 16
                yield _segment(*fixed, "tail", tail[since - 16 - place : until - place], key)

    return splits.select("path", "start", "at", "end", "data", "length", "head", "tail", "carry", "data_key").mapInArrow(run, SEGMENT)


def _fragments(edges: DataFrame) -> DataFrame:
    """``(path, start, part, bytes, opens, unresolved)``: what a split has of rows that go on
    beyond it.  Part 0 ends a row, part 1 begins one; a split without LF is all part 0."""
    plain = edges.select("path", "start", "first", "last", "kind", _decrypted(F.col("body"), F.col("closing"), F.col("data_key")).alias("plain"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["path", "start", "part", "bytes", "opens", "unresolved"]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                split, kind, data = (row["path"], row["start"]), row["kind"], row["plain"]
                if row["last"] and kind != "head":
                    data = _unpadded(data)
                at, last = data.find(b"\n"), data.rfind(b"\n")
                if at < 0:
                    # Only a whole split may have no LF: then more of both ends is needed.
                    found.append((*split, 0, data, False, kind != "all"))
                    continue
                if kind != "tail" and not row["first"]:
                    found.append((*split, 0, data[: at + 1], False, False))
                if kind != "head":
                    found.append((*split, 1, data[last + 1 :], True, False))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, kinds)], names)

    return plain.mapInArrow(run, "path string, start long, part int, bytes binary, opens boolean, unresolved boolean")


def _crossing_lines(fragments: DataFrame) -> DataFrame:
    """The lines put together from fragments: each begins where a split opens one."""
    order = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = fragments.withColumn("row", F.sum(F.col("opens").cast("int")).over(order))
    entry = F.sort_array(F.collect_list(F.struct("start", "part", "bytes")))
    whole = rows.groupBy("path", "row").agg(entry.alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda found, piece: F.concat(found, piece["bytes"]))
    return whole.select(F.regexp_replace(joined.cast("string"), "\n$", "").alias("line"))


def open_in_splits(
    spark: SparkSession,
    path: str,
    keyring: Keyring,
    schema: T.StructType | str,
    key_id: int | None = None,
    glob: str = SEALED_GLOB,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """Rows of the files above ``whole_bytes``, each read by as many tasks as it has splits.

    The ciphertext is scanned twice: once for the places and ends of splits, which are
    stored (as ciphertext), once to decrypt.  Only a row longer than ``EDGE_BYTES`` across
    two splits makes the first scan run again, with longer ends.
    """
    schema = payload.as_schema(schema)
    parts, edge = _parts(spark, path, glob, whole_bytes), EDGE_BYTES
    while True:
        noted = work_path(spark, "splits")
        _summary(parts, edge).write.parquet(noted)
        summary = spark.read.schema("path string, start long, length long, n long, head binary, tail binary").parquet(noted)
        splits = _placed(summary, keyring, key_id)
        fragments = _fragments(_edges(_with_ends(splits, summary)))
        if fragments.where("unresolved").isEmpty():
            break
        edge *= 16
    lines = _inner_lines(_stretches(parts, splits), payload.csv_header(schema)).unionByName(_crossing_lines(fragments))
    # Few files have CR at all, and a search for it costs far less than the expression.
    bare = F.when(F.contains("line", F.lit("\r")), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    return payload.decode(lines.select(bare.alias("line")).where("line <> ''"), schema, "csv", escape=False)


# ---- writing and changing keys -------------------------------------------


def seal_files(df: DataFrame, keyring: Keyring, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``(name, content)``: whole CSV files of at most ``file_bytes`` or one line, each one
    ciphertext under the active key, which it names.  Neighbouring rows of a task are packed
    as the other layouts pack them, without a shuffle."""
    lines = df.select(payload.csv_line(df.schema, escape=False).alias("line"))
    blocks = pack_lines(lines, file_bytes)
    name = F.format_string("part-%05d-%012d.csv.cbc", F.spark_partition_id(), F.monotonically_increasing_id())
    body = F.concat(F.lit(payload.csv_header(df.schema) + "\n"), F.col("block"), F.lit("\n"))
    sealed = encrypt_bytes(body.cast("binary"), keyring.active_key())
    return blocks.select(name.alias("name"), F.concat(F.lit(file_head(keyring.active_id)), sealed).alias("content"))


def write_files(
    df: DataFrame, target: str, keyring: Keyring, save_mode: str = "errorifexists", file_bytes: int = FILE_BYTES
) -> None:
    """Write ``df`` as whole encrypted CSV files in ``target``."""
    from pyarrow import fs

    if save_mode != "errorifexists":
        raise ValueError("files are only written to a new folder")
    store, root = fs.FileSystem.from_uri(target)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{target} exists already")
    staged = work_path(df.sparkSession, "files")
    # Ciphertext neither compresses nor repeats.  Sizes are checked at every row, or a hundred
    # whole files would be one page.
    options = {"compression": "none", "parquet.enable.dictionary": "false"}
    checks = {f"parquet.{k}.size.row.check.min": "1" for k in ("page", "block")}
    seal_files(df, keyring, file_bytes).write.options(**options, **checks).parquet(staged)
    export_files(df.sparkSession.read.parquet(staged), target)


def export_files(files: DataFrame, target: str) -> None:
    """Store ``(name, content)`` rows as files under ``target``, a folder all executors reach.

    A file appears under its name only when it is whole.  A repeated task puts its own in
    place of it, so rows made anew must stand for the same data, if not for the same bytes.
    """

    def save(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                folder, _, name = f"{root}/{batch.column(0)[k].as_py()}".rpartition("/")
                store.create_dir(folder, recursive=True)
                draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(batch.column(1)[k].as_buffer())
                store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    # As Arrow buffers, so that a file's bytes are not copied again for each row.
    files.select("name", "content").mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()


def rekey_files(
    spark: SparkSession,
    source: str,
    target: str,
    keyring: Keyring,
    key_id: int | None = None,
    partitions: int | None = None,
    glob: str = SEALED_GLOB,
) -> int:
    """Copy every file to ``target``, encrypted under the active key and naming it; files that
    are already under that key are copied as they are.  Returns how many were made.

    A file that stands in ``target`` is whole, so a run that was stopped goes on where it
    ended when it is run again.  Names below ``source`` stay.
    """
    from pyarrow import fs

    # Both sides are named by their path below the folder, whatever scheme leads to it.
    def named(folder: str) -> DataFrame:
        root = fs.FileSystem.from_uri(folder)[1].rstrip("/") + "/"
        below = F.substr("path", F.instr("path", root) + len(root))
        return find_files(spark, folder, glob).withColumn("name", below)

    files = named(source)
    store, root = fs.FileSystem.from_uri(target)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        files = files.join(named(target).select("name"), "name", "left_anti")
    todo = gathered(files, partitions)
    count = files.select("name").count()
    sealed = keyring.attach(named_files(todo.select("name", "content"), keyring, key_id))
    plain = decrypt_bytes(F.col("body"), F.col("data_key"))
    fresh = encrypt_bytes(plain, keyring.active_key())
    body = F.when(F.col("key_id") == keyring.active_id, F.col("body")).otherwise(fresh)
    export_files(sealed.select("name", F.concat(F.lit(file_head(keyring.active_id)), body).alias("content")), target)
    return count
