"""Operator 8: token counts by a finite-state tokenizer.

Two deterministic transducers, one after the other:

* ``Splitter`` reads character classes and marks where pre-tokens begin.  It has 13
  states; a transition's output says whether a pre-token begins at the character read
  and whether one begins at the character before it (one character of lookahead is all
  the pattern needs).  A run over a buffer cuts it into chunks of ``CHUNK`` characters.
  All chunks are read at once, each from every state; the resulting state maps compose
  by a parallel prefix scan, which gives each chunk its true first state, and a second
  pass from there writes the marks.  A text of any length is thus many chunks.
* ``Counter`` reads a pre-token's bytes.  Its transitions carry the change of the token
  count, so the sum along the path is the number of tokens.  A state is the longest
  suffix that some token starts with, and for each place inside it the last token of
  the text up to there with the count relative to here.  That is all that later bytes
  can depend on: the last token of a prefix is the one token among its suffixes that
  stays beside the last token before it (their joint encoding is just the two).  States
  are made when first reached and numbered.

Strings of added tokens are found first and count as one token each, as the library does
by default.

Defined cases: a null text counts as empty and has no tokens and no bytes; repeated rows
and ids each give a row; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common, pretokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CHUNK = 512
# Counts of pre-tokens a worker remembers, and transitions it keeps, before it starts afresh.
MEMO, TRANSITIONS = 500_000, 1_000_000

# Character classes.
BLANK, SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, ELL, E, END = range(12)
# States.
DONE, IN_L, IN_N, IN_O, Q, Q_R, Q_V, Q_L, ONE_B, ONE_S, MANY_B, MANY_S = range(12)
STATES = 12
HERE, BEFORE = 1, 2
_letters = {LETTER, STMD, R, V, ELL, E}


def _begin(c: int) -> int:
    """The state after the first character of a pre-token."""
    if c in _letters:
        return IN_L
    return {BLANK: ONE_B, SPACE: ONE_S, NUMBER: IN_N, OTHER: IN_O, QUOTE: Q, END: DONE}[c]


def _move(state: int, c: int) -> tuple[int, int]:
    """Next state and output of one transition."""
    run = IN_L if c in _letters else {NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O}.get(c)
    if c == END:
        # A text ends: an unfinished contraction was a quote and a letter.
        return DONE, HERE | (BEFORE if state in (Q_R, Q_V, Q_L) else 0)
    if state == Q:
        if c == STMD:
            return DONE, 0
        if c in (R, V, ELL):
            return {R: Q_R, V: Q_V, ELL: Q_L}[c], 0
        return (IN_O, 0) if run == IN_O else (_begin(c), HERE)
    if state in (Q_R, Q_V, Q_L):
        if c == (ELL if state == Q_L else E):
            return DONE, 0
        return (IN_L, BEFORE) if run == IN_L else (_begin(c), BEFORE | HERE)
    if state in (IN_L, IN_N, IN_O):
        return (state, 0) if run == state else (_begin(c), HERE)
    if state in (ONE_B, ONE_S, MANY_B, MANY_S):
        if c in (BLANK, SPACE):
            return (MANY_S if c == SPACE else MANY_B), 0
        # The last blank of several begins anew; a space joins what follows it.
        out = BEFORE if state in (MANY_B, MANY_S) else 0
        return (run, out) if state in (ONE_S, MANY_S) else (_begin(c), out | HERE)
    return _begin(c), HERE


_NEXT = np.array([[_move(s, c)[0] for c in range(12)] for s in range(STATES)], np.uint8).ravel()
_OUT = np.array([[_move(s, c)[1] for c in range(12)] for s in range(STATES)], np.uint8).ravel()


@cache
def _classes() -> np.ndarray:
    """The class of every code point, from the pattern engine's own properties."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text = "".join(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, text):
            table[ord(text[m.start()]) : ord(text[m.end() - 1]) + 1] = kind
    for letters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E)):
        for x in letters:
            table[ord(x)] = kind
    return table


def starts(classes: np.ndarray) -> np.ndarray:
    """Marks of the characters at which a pre-token begins; texts are separated by END,
    which is marked as well.  Reading starts in DONE."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    # Each chunk from every state: its state map.
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None, :], lanes, axis=0)
    for step in grid:
        maps = _NEXT[maps * np.uint8(12) + step[:, None]]
    # Prefix scan: after round k a map covers the 2^k chunks that end with its own.
    reach = 1
    while reach < lanes:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.r_[np.uint8(DONE), maps[:-1, DONE]].astype(np.uint8)
    marks = np.empty((CHUNK, lanes), np.uint8)
    for k, step in enumerate(grid):
        at = state * np.uint8(12) + step
        marks[k] = _OUT[at]
        state = _NEXT[at]
    flat = np.ascontiguousarray(marks.T).ravel()[:n]
    begin = (flat & HERE) > 0
    begin[:-1] |= (flat[1:] & BEFORE) > 0
    return begin


class Counter:
    """Counts the tokens of a pre-token while reading its bytes."""

    def __init__(self, path: str = VOCABULARY):
        ids, self.merges = pretokens.merges_of(path)
        self.tokens = set(ids)
        self.heads = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        # A state: (suffix, last tokens, counts), all but the suffix by place in it.
        self.states: list[tuple] = [(b"", (b"",), (0,))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.links: dict[tuple[bytes, int], tuple] = {}
        self.memo: dict[bytes, int] = {}

    def encode(self, raw: bytes) -> list[bytes]:
        """The merges as they are defined, for pairs of tokens only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            pairs = [self.merges.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            best = min(pairs)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(pairs) and pairs[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens side by side stay as they are."""
        known = self.beside.get((left, right))
        if known is None:
            known = not left and self.encode(right) == [right] or self.encode(left + right) == [left, right]
            if len(self.beside) >= TRANSITIONS:
                self.beside.clear()
            self.beside[left, right] = known
        return known

    def make(self, state: int, byte: int) -> tuple[int, int]:
        """A transition taken for the first time."""
        suffix, last, counts = self.states[state]
        link = self.links.get((suffix, byte))
        if link is None:
            text = suffix + bytes([byte])
            found = [(k, text[k:]) for k in range(len(text)) if text[k:] in self.tokens]
            cut = next(k for k in range(len(text) + 1) if text[k:] in self.heads)
            link = self.links[suffix, byte] = found, cut, text[cut:]
        found, cut, kept = link
        known = self.beside
        for begin, token in found:
            left = last[begin]
            stays = known.get((left, token))
            if stays or stays is None and self.stays(left, token):
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        change = counts[begin] + 1
        key = (kept, (*last[cut:], token), (*[c - change for c in counts[cut:]], 0))
        new = self.number.setdefault(key, len(self.states))
        if new == len(self.states):
            self.states.append(key)
        move = self.moves[state << 8 | byte] = new, change
        return move

    def count(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        known = self.memo.get(raw)
        if known is not None:
            return known
        if len(self.moves) > TRANSITIONS or len(self.memo) >= MEMO:
            self.forget()
        state = total = 0
        moves = self.moves
        for byte in raw:
            move = moves.get(state << 8 | byte) or self.make(state, byte)
            state = move[0]
            total += move[1]
        if len(raw) <= 64:
            self.memo[raw] = total
        return total


@lru_cache(1)
def counter_of(path: str) -> Counter:
    """The counter of a worker process; its states serve all its tasks."""
    made = Counter(path)
    common.collect_rarely()
    return made


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the joined texts, and begin, end and text number of each pre-token."""
    # One character ends each text; it is a class of its own, whatever it is.
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = _classes()[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes[ends] = END
    begin = starts(classes)
    begin[ends] = True
    first = np.flatnonzero(begin)
    width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    place = np.r_[0, np.cumsum(width)]
    owner = np.searchsorted(ends, first)
    real = first != ends[owner]
    stop = np.r_[first[1:], len(points)]
    data = np.frombuffer(joined.encode(), np.uint8)
    return data, place[first[real]], place[stop[real]], owner[real]


def count_texts(texts: list[str], counter: Counter) -> np.ndarray:
    """Tokens of each text."""
    data, begin, end, owner = _spans(texts)
    if not len(begin):
        return np.zeros(len(texts), np.int64)
    _, first, same = np.unique(common.span_hashes(data, begin, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    found = np.array([counter.count(raw[a:b]) for a, b in zip(begin[first].tolist(), end[first].tolist())])
    return np.bincount(owner, weights=found[same], minlength=len(texts)).astype(np.int64)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    added: tuple[str, ...] = (pretokens.SPECIAL,),
) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row."""
    cut = re.compile("|".join(map(re.escape, added))) if added else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            at, _ = common.buffers(batch.column(1))
            out = np.zeros(batch.num_rows, np.int64)
            for first, last in common.slices(at):
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                parts, of = texts, np.arange(first, last)
                if cut and any(map(cut.search, texts)):
                    split = [cut.split(t) for t in texts]
                    of = np.repeat(of, [len(s) for s in split])
                    parts = [p for s in split for p in s]
                    out[first:last] += [len(s) - 1 for s in split]
                np.add.at(out, of, count_texts(parts, counter))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(out)], ["id", "n_bytes", "n_tokens"]
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they are more than 1024."""
    return token_counts(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")
    )
