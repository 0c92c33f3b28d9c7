"""Operator 2: substring deduplication by content-defined chunks, exact by words.

A gear hash rolls over the bytes of a text: each step shifts the hash and adds a table value
for the byte, so it depends on the last eight bytes only.

``without_passages`` cuts every word that lies in ``PASSAGE`` words in a row which a document
of smaller id has too.  A chunk ends at each word whose gear hash is the least of some
``NEAR`` words in a row around it, so chunks have ``NEAR`` words at most, about half of that
mostly, and an insertion changes only those beside it.  Every passage of that length holds
several chunks that depend on nothing outside it.  Digests of ``CHUNKS`` of them in a row are
grouped; the least digest inside a window of ``PASSAGE`` words is the window's seed.  Equal
windows have equal seeds, and neighbouring windows mostly share theirs, so seeds are few;
windows are hashed and compared only where a seed is in several documents, word by word
and whatever the blanks.  A match is one run of words in one other document, and is as long
as it is there.

``without_repeats`` cuts out runs of repeated chunks instead.  There a chunk ends at a blank
whose eight-bit hash is below ``CUT_BELOW``, about every fifth word; in a stretch without
blanks it may end between any two characters.  A chunk is repeated in a document if its
digest also occurs in one of smaller id.  Runs of repeated chunks of ``min_words`` words or
more are cut out; they need not stand in a row in one other document, and some passages of
over 50 words have no such run.

Digests are grouped with partial sums, and only digests of several documents are joined
to their rows again; a digest in very many documents is a skewed join, which Spark splits.

Defined cases: a null or empty text stays as it is; a row without id keeps its text and
is no source for others; rows of one id are one document, which repeats nothing of
itself; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common

WINDOW = 8
# Of 256 values of the hash, those that end a chunk at a blank, and away from blanks.
CUT_BELOW, CUT_BELOW_INSIDE = 48, 8
# Bytes without a blank after which a chunk may end inside them.
NO_BLANK = 64
MIN_WORDS = 28
# Words of the shortest passage; words around a chunk's end of which it has the least hash;
# chunks in a row that make a digest.
PASSAGE, NEAR, CHUNKS = 50, 8, 3
# Words of a passage after which hashes no longer depend on what stands before it: eight bytes
# are four words at most.
_AWAY = 4

_GEAR = (common.mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint8)
_WIDE = (common.mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_BLANK = common._SPACE


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of table values, shifted once a step."""
    h = _GEAR[data]
    for width in (1, 2, 4):
        shifted = h[:-width] << np.uint8(width) if len(h) > width else h[:0]
        h = h.copy()
        h[width:] += shifted
    return h


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end in the joined texts; ``ends`` are the ends of the texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = gear(data)
    blank = _BLANK[data]
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(blank, place, 0))
    cut = blank & (h < CUT_BELOW)
    inside = np.flatnonzero((place - last >= NO_BLANK) & (h < CUT_BELOW_INSIDE))
    inside = inside[inside + 1 < len(data)]
    cut[inside[(data[inside + 1] & 0xC0) != 0x80]] = True
    # The window must lie in one text.
    starts = np.r_[0, ends[:-1]]
    for k in range(WINDOW - 1):
        at = starts + k
        cut[at[at < len(data)]] = False
    cut[ends[ends > 0] - 1] = True
    return np.flatnonzero(cut) + 1


def _chunked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with their bytes, chunk ends and the row of each chunk."""
    at, raw = common.buffers(column)
    for first, last in common.slices(at):
        base = int(at[first])
        data = raw[base : int(at[last])]
        ends = at[first + 1 : last + 1] - base
        cuts = chunk_ends(data, ends)
        yield first, last, data, cuts, np.searchsorted(ends, cuts, "left")


def chunks(docs: DataFrame) -> DataFrame:
    """``(digest, doc_id, no)`` of every chunk of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, cuts, row in _chunked(batch.column(1)):
                if not len(cuts):
                    continue
                digest = common.span_hashes(data, np.r_[0, cuts[:-1]], cuts)
                no = np.arange(len(cuts)) - np.searchsorted(row, row)
                columns = [common.longs(digest), ids[first + row], no.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digest", "doc_id", "no"])

    return docs.where("doc_id is not null").mapInArrow(run, "digest long, doc_id long, no int")


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, repeats)``: numbers of the chunks that a document of smaller id has."""
    parts = chunks(docs)
    several = parts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = common.stored(several.where("least < most").select("digest", "least"), "repeated")
    hits = parts.join(several, "digest").where("doc_id > least")
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("no")).alias("repeats"))


def _kept(data: np.ndarray, ends: np.ndarray, hits: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """The spans of a text to cut out: long enough runs of repeated chunks."""
    flags = np.zeros(len(ends) + 2, np.int8)
    flags[1 + hits[hits < len(ends)]] = 1
    change = np.diff(flags)
    spans = []
    for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
        start, stop = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        if len(common.word_spans(data[start:stop])[0]) >= min_words:
            spans.append((start, stop))
    return spans


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and two more columns:
    ``n_chunks`` and ``removed``, the spans cut out as code points from, to, from, to."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = list(docs.columns)
    rest = F.struct(*(F.col(n) for n in names if n != "text")).alias("rest")
    held = docs.select(rest, F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = held.join(repeated(plain), "doc_id", "left").select("rest", "text", "repeats")
    schema = both.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                repeats = batch.column(2)
                texts = batch.column(1).to_pylist()
                counts, removed = np.zeros(batch.num_rows, np.int64), [[] for _ in texts]
                for first, _, data, cuts, row in _chunked(batch.column(1)):
                    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
                    for a, b in zip(begin, [*begin[1:], len(row)]):
                        k = first + int(row[a])
                        counts[k] = b - a
                        if not repeats[k].is_valid:
                            continue
                        start = int(cuts[a - 1]) if a else 0
                        text = data[start : int(cuts[b - 1])]
                        spans = _kept(text, cuts[a:b] - start, np.array(repeats[k].as_py()), min_words)
                        if not spans:
                            continue
                        kept, place, gone = [], 0, 0
                        for s, e in spans:
                            before = text[place:s].tobytes().decode()
                            inside = len(text[s:e].tobytes().decode())
                            kept.append(before)
                            gone_at = gone + len(before)
                            removed[k] += [gone_at, gone_at + inside]
                            gone, place = gone_at + inside, e
                        texts[k] = "".join(kept) + text[place:].tobytes().decode()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(counts), pa.array(removed, pa.list_(pa.int64()))],
                    ["rest", "text", "n_chunks", "removed"],
                )

    out = both.mapInArrow(run, f"rest {schema}, text string, n_chunks long, removed array<long>")
    return out.select(*("text" if n == "text" else F.col(f"rest.{n}").alias(n) for n in names), "n_chunks", "removed")


def _grams(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many words."""
    up, down = common._power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return common.mixed((sums[words:] - sums[:-words]) * down[: len(hashes) - words + 1] + np.uint64(words))


def _word_gear(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A sixteen-bit gear hash at the end of each word, over the text with one blank between
    words: two bits a step, so that eight bytes fill it."""
    blank = _BLANK[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    text = np.where(blank, np.uint8(0x20), data)[keep]
    h = _WIDE[text]
    for width in (1, 2, 4):
        shifted = h[:-width] << np.uint16(2 * width) if len(h) > width else h[:0]
        h = h.copy()
        h[width:] += shifted
    return h[np.cumsum(keep)[end - 1] - 1]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def word_cuts(h: np.ndarray) -> np.ndarray:
    """Numbers of the words that end a chunk: those of least hash in some run of NEAR words."""
    if len(h) < NEAR:
        return np.zeros(0, np.int64)
    least = _least(h, NEAR)
    # The greatest of the minima of the runs that a word is in; at both ends there are fewer.
    padded = np.r_[np.zeros(NEAR - 1, h.dtype), least, np.zeros(NEAR - 1, h.dtype)]
    most = ~_least(~padded, NEAR)
    return np.flatnonzero(most == h)


def _chunk_seeds(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The seed of each window of PASSAGE words: the least digest of CHUNKS chunks in a row
    whose ends depend on the window's words only."""
    cuts = word_cuts(h)
    up, down = common._power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    before, after = cuts[:-CHUNKS], cuts[CHUNKS:]
    digest = common.mixed((sums[after + 1] - sums[before + 1]) * down[before + 1] + (after - before).astype(np.uint64))
    first = np.arange(len(hashes) - PASSAGE + 1)
    low = np.searchsorted(cuts, first + _AWAY + NEAR - 1, "left")
    high = np.searchsorted(cuts, first + PASSAGE - NEAR, "right") - CHUNKS  # digests from low to before high
    out = np.empty(len(first), np.uint64)
    power, table = 0, digest
    while True:
        # Ranges that two runs of this width cover.
        size = high - low
        rows = np.flatnonzero((size >= 1 << power) & (size < 2 << power))
        if len(rows):
            out[rows] = np.minimum(table[low[rows]], table[high[rows] - (1 << power)])
        if len(table) <= 1 << power or not (size >= 2 << power).any():
            return out
        table = np.minimum(table[: -(1 << power)], table[1 << power :])
        power += 1


def _windows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of rows: the row of each window of PASSAGE words, the number of its first
    word in the row, its seed and its hash."""
    at, raw = common.buffers(column)
    for first, last in common.slices(at):
        base = int(at[first])
        ends = at[first + 1 : last + 1] - base
        data = np.insert(raw[base : int(at[last])], ends, 0x20)
        start, end = common.word_spans(data)
        if len(start) < PASSAGE:
            continue
        row = np.searchsorted(ends + np.arange(1, last - first + 1), start, "right")
        no = np.arange(len(start)) - np.searchsorted(row, row)
        hashes = common.span_hashes(data, start, end)
        # A window over two rows has a seed that means nothing; it is left out.
        seed = _chunk_seeds(hashes, _word_gear(data, start, end))
        whole = np.flatnonzero(row[: 1 - PASSAGE] == row[PASSAGE - 1 :])
        yield first + row[whole], no[whole], seed[whole], _grams(hashes, PASSAGE)[whole]


def _seeds(docs: DataFrame) -> DataFrame:
    """``(digest, doc_id, mark)`` of the seeds of ``docs (doc_id, mark, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.trimmed(batches):
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, _, seed, _ in _windows(batch.column(2)):
                new = np.ones(len(row), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
                columns = [common.longs(seed[new]), ids[row[new]], marks[row[new]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digest", "doc_id", "mark"])

    return docs.mapInArrow(run, "digest long, doc_id long, mark int")


def _places(docs: DataFrame) -> DataFrame:
    """``(digest, doc_id, mark, place)`` of the windows of ``docs (doc_id, mark, text,
    seeds)`` that have one of the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.trimmed(batches):
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, no, seed, digest in _windows(batch.column(2)):
                seed, good = common.longs(seed), np.zeros(len(row), bool)
                begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
                for a, b in zip(begin, [*begin[1:], len(row)]):
                    good[a:b] = np.isin(seed[a:b], batch.column(3)[int(row[a])].values.to_numpy(zero_copy_only=False))
                columns = [common.longs(digest[good]), ids[row[good]], marks[row[good]], no[good].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digest", "doc_id", "mark", "place"])

    return docs.mapInArrow(run, "digest long, doc_id long, mark int, place int")


def passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, places)`` for ``docs (doc_id, mark, text)``: first words of the
    windows that a document of smaller id has.  What it takes to find them is deleted."""

    def several(rows: DataFrame) -> DataFrame:
        ids = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        return common.stored(ids.where("least < most").select("digest", "least"), "repeated")

    docs = docs.where("doc_id is not null")
    seeds = _seeds(docs)
    repeated_seeds = several(seeds)
    shared = seeds.join(repeated_seeds.select("digest"), "digest")
    shared = shared.groupBy("doc_id", "mark").agg(F.collect_set("digest").alias("seeds"))
    windows = docs.join(shared, ["doc_id", "mark"]).select("doc_id", "mark", "text", "seeds")
    windows = common.stored(_places(windows), "windows")
    repeated_windows = several(windows)
    again = windows.join(repeated_windows, "digest").where("doc_id > least")
    places = common.stored(again.groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places")), "places")
    common.discard(repeated_seeds, windows, repeated_windows)
    return places


def _without(text: str, places: np.ndarray) -> tuple[str, list[int]]:
    """The text without the windows that begin at those words, and the spans cut out."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, _ = common.word_spans(data)
    change = np.zeros(len(start) + 1, np.int64)
    places = np.unique(places)
    np.add.at(change, places, 1)
    np.add.at(change, places + PASSAGE, -1)
    gone = np.diff(np.r_[0, (np.cumsum(change)[:-1] > 0).astype(np.int8), 0])
    edges = np.r_[start, len(data)]
    kept, removed, place, length = [], [], 0, 0
    for a, b in zip(np.flatnonzero(gone == 1).tolist(), np.flatnonzero(gone == -1).tolist()):
        s, e = int(edges[a]), int(edges[b])
        kept.append(data[place:s].tobytes().decode())
        length += len(kept[-1])
        removed.append(length)
        length += len(data[s:e].tobytes().decode())
        removed.append(length)
        place = e
    return "".join(kept) + data[place:].tobytes().decode(), removed


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages of PASSAGE words or more that a document of smaller id
    has, and ``n_chunks`` and ``removed`` as in ``without_repeats``, unless ``docs`` has columns
    of these names, which then stay as they are."""
    names = list(docs.columns)
    # Rows of one id may have several texts.
    mark = F.hash("text").alias("mark")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark, "text")
    rest = F.struct(*(F.col(n) for n in names if n != "text")).alias("rest")
    held = docs.select(rest, F.col("doc_id").cast("long").alias("doc_id"), mark, "text")
    both = held.join(passages(plain), ["doc_id", "mark"], "left").select("rest", "text", "places")
    schema = both.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.trimmed(batches):
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                places, texts = batch.column(2), batch.column(1).to_pylist()
                counts, removed = np.zeros(batch.num_rows, np.int64), [[] for _ in texts]
                for first, last, _, _, row in _chunked(batch.column(1)):
                    counts[first:last] = np.bincount(row, minlength=last - first)
                for k in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[k], removed[k] = _without(texts[k], places[k].values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(counts), pa.array(removed, pa.list_(pa.int64()))],
                    ["rest", "text", "n_chunks", "removed"],
                )

    out = both.mapInArrow(run, f"rest {schema}, text string, n_chunks long, removed array<long>")
    more = [n for n in ("n_chunks", "removed") if n not in names]
    return out.select(*("text" if n == "text" else F.col("rest")[n].alias(n) for n in names), *more)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that one of smaller id has."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_passages(docs).select(
        "doc_id", "n_chunks", "removed", F.length("text").cast("long").alias("n_chars_kept"), "text"
    )
