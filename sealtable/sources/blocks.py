"""Packing many text lines into one value before encryption, and back.

Starting a cipher costs far more than encrypting a hundred bytes, so rows are
encrypted in blocks.  Packing needs neighbouring rows of one task and nothing
else; Spark's own operators could only gather them through a shuffle, hence one
``mapInArrow`` whose body joins strings inside Arrow.  Blocks may be compressed on
the way, which must come before encryption and which Spark has no function for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

BLOCK_BYTES = 256 * 1024
# Blocks that go back from a worker together have about so many bytes.
BATCH_BYTES = 8 * 1024 * 1024


def pack_lines(lines: DataFrame, block_bytes: int = BLOCK_BYTES, codec: str | None = None) -> DataFrame:
    """Join lines with ``\\n`` into blocks of about ``block_bytes``; a longer line is a block alone.

    Blocks are text, or bytes when ``codec`` is ``zstd``.
    """
    _known(codec)
    if block_bytes <= 0 and codec is None:
        return lines.withColumnRenamed(lines.columns[0], "block")

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []  # slices of lines that make up the open block, whatever batch they came in
        size = 0
        zip_ = None if codec is None else pa.Codec(codec).compress
        newline = pa.scalar("\n", pa.large_string())

        def joined():
            lines = pa.concat_arrays(held)
            held.clear()
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), lines), newline)

        def batch_of(blocks: list) -> pa.RecordBatch:
            # A block may be a whole file: one alone is passed on without a copy.
            texts = blocks[0] if len(blocks) == 1 else pa.concat_arrays(blocks)
            if zip_ is None:
                return pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["block"])
            zipped = pa.array([zip_(text.as_buffer(), asbytes=True) for text in texts], pa.binary())
            return pa.RecordBatch.from_arrays([zipped], ["block"])

        for batch in batches:
            # 64-bit offsets: a batch of long texts may exceed 2 GiB.
            texts = batch.column(0).cast(pa.large_string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64") + 1)
            at, done, ready, ready_bytes = 0, 0, [], 0
            while at < len(ends):
                cut = int(np.searchsorted(ends, done + block_bytes - size, side="right"))
                if cut <= at and not held:
                    cut = at + 1
                if cut > at:
                    held.append(texts.slice(at, cut - at))
                    size += int(ends[cut - 1]) - done
                    at, done = cut, int(ends[cut - 1])
                if at < len(ends) or size >= block_bytes:
                    ready.append(joined())
                    ready_bytes, size = ready_bytes + size, 0
                if ready_bytes >= BATCH_BYTES:
                    yield batch_of(ready)
                    ready, ready_bytes = [], 0
            if ready:
                yield batch_of(ready)
        if held:
            yield batch_of([joined()])

    return lines.mapInArrow(pack, "block string" if codec is None else "block binary")


def unpack_lines(blocks: DataFrame, codec: str) -> DataFrame:
    """Lines of compressed blocks; the single column of ``blocks`` holds their bytes."""
    _known(codec)

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def lines_of(texts: list) -> pa.RecordBatch:
            text = pa.array([b"\n".join(texts)], pa.large_binary()).cast(pa.large_string())
            lines = pc.split_pattern(text, "\n").flatten()
            return pa.RecordBatch.from_arrays([lines.cast(pa.string())], ["line"])

        for batch in batches:
            # Small blocks go back together.
            texts, size = [], 0
            for block in batch.column(0):
                with pa.CompressedInputStream(pa.BufferReader(block.as_buffer()), codec) as stream:
                    texts.append(stream.read())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield lines_of(texts)
                    texts, size = [], 0
            if texts:
                yield lines_of(texts)

    return blocks.mapInArrow(unpack, "line string")


def _known(codec: str | None) -> None:
    if codec not in (None, "zstd"):
        raise ValueError(f"unknown codec {codec!r}")
