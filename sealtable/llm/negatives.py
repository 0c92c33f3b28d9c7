"""Operator 13: hard negatives by angular triangle filtering.

Vectors become integers, ``floor(256 * x)``; scores are their inner products.  For each
length of vectors a few reference directions are fixed: the means of the vectors by hash of
label.  Every row stores its angles to them, and its norm.  For an anchor at angle ``a`` to
a reference and a row at angle ``b``, the angle between the two lies between ``|a - b|`` and
``min(a + b, 2 pi - a - b)``.  Over all references that gives an interval of angles, hence of
cosines, and times both norms of scores, widened by more than rounding can amount to.

Two passes use the intervals.  The first finds each anchor's positives: a row is scored only
if its upper bound reaches the anchor's present last place.  The second finds the negatives:
each positive has a window of scores, and a row is scored only if its interval overlaps one
that still has a place for it.  Rows in a block stand in order of the angle to the
block's most telling reference, so the rows that can reach a window are one stretch of the
block, found by bisection; the other references are tried on that stretch only.

Anchors are a stated set of queries, one row in a hundred.  Rows and anchors are packed into
blocks of bounded size; each block of anchors meets each block of rows once, in one of
``SALTS`` tasks a block of anchors, which keeps only the best rows of each anchor (or
positive) while it reads.  What a task returns is hence bounded by its anchors, and pairs are
never rows.

Defined cases: rows without id, label or vector, and rows with a null or non-finite
component, take no part; rows equal in id, label and vector count once, other rows that
share an id are rows of their own (one of the anchor's id, label and integers is the anchor
itself); vectors of different lengths have no score; vectors of
length 0 score 0; other columns are never read; an empty table gives no rows.  Scores are
exact, by doubles where these hold them and by Python's integers beyond; a score outside 64
bits fails the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealtable.llm import common

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
LOW, HIGH = 80, 100  # percent of the positive's score that a negative may have
REFERENCES, BLOCK, ANCHORS, SALTS = 16, 2048, 1024, 16
# Angles are off by less than this: rounding of the cosines of near-parallel vectors included.
ANGLE_SLACK = 1e-6
EXACT = 1 << 53

ROW_SCHEMA = "dim int, block long, n int, body binary"


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, label, embedding)`` of the rows that take part, equal ones once."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
    )
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(whole).distinct()


# ---- packed rows ---------------------------------------------------------


class Rows:
    """Rows of one length as arrays; ``to_bytes`` and ``from_bytes`` carry them in one value."""

    def __init__(self, ids, labels, q, norms, angles):
        self.ids, self.labels, self.q, self.norms, self.angles = ids, labels, q, norms, angles

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, index: np.ndarray) -> Rows:
        return Rows(self.ids[index], self.labels[index], self.q[index], self.norms[index], self.angles[index])

    def to_bytes(self) -> bytes:
        return b"".join(np.ascontiguousarray(a).tobytes() for a in (self.ids, self.labels, self.norms, self.angles, self.q))

    @staticmethod
    def from_bytes(body: bytes, n: int, dim: int) -> Rows:
        flat = np.frombuffer(body, np.float64)
        refs = len(flat) // n - 3 - dim if n else 0
        ids, labels = flat[:n].view(np.int64), flat[n : 2 * n].view(np.int64)
        norms, rest = flat[2 * n : 3 * n], flat[3 * n :]
        return Rows(ids, labels, rest[n * refs :].reshape(n, dim), norms, rest[: n * refs].reshape(n, refs))


def _norms(q: np.ndarray) -> np.ndarray:
    """Lengths; large components are scaled first, so that squares stay finite."""
    top = np.abs(q).max(axis=1, initial=0)
    scale = np.where(top > 0, top, 1)
    return np.sqrt(((q / scale[:, None]) ** 2).sum(axis=1)) * scale


def angles_to(q: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit references; a zero vector counts as orthogonal to all."""
    unit = q / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(length, ids, labels, integer components)`` of a batch, by length."""
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    lists = batch.column("embedding")
    starts = lists.offsets.to_numpy()
    sizes, values = np.diff(starts), lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        at = starts[:-1][rows][:, None] + np.arange(dim)
        yield dim, ids[rows], labels[rows], np.floor(values[at] * SCALE).reshape(len(rows), dim)


def references(rows: DataFrame) -> DataFrame:
    """``(dim, body)``: for each length the unit means of rows by hash of label."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, labels, q in _arrays(batch):
                kind = (common.mixed(labels.astype(np.uint64)) % np.uint64(REFERENCES)).astype(np.int64)
                norms = _norms(q)
                unit = q / np.where(norms > 0, norms, 1)[:, None]
                for k in np.unique(kind).tolist():
                    total = unit[kind == k].sum(axis=0)
                    columns = [np.full(dim, dim, np.int32), np.full(dim, k, np.int32), np.arange(dim, dtype=np.int32), total]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "kind", "at", "total"])

    def unit_rows(found: pa.Table) -> pa.Table:
        dim = found["dim"][0].as_py()
        means = np.zeros((REFERENCES, dim))
        means[found["kind"].to_numpy(), found["at"].to_numpy()] = found["total"].to_numpy()
        lengths = _norms(means)
        # A mean of zero is no direction; an axis is.
        flat = np.flatnonzero(lengths == 0)
        means[flat, flat % dim] = lengths[flat] = 1
        return pa.table({"dim": pa.array([dim], pa.int32()), "body": pa.array([(means / lengths[:, None]).tobytes()], pa.binary())})

    parts = rows.mapInArrow(sums, "dim int, kind int, at int, total double")
    whole = parts.groupBy("dim", "kind", "at").agg(F.sum("total").alias("total"))
    return whole.groupBy("dim").applyInArrow(unit_rows, "dim int, body binary")


def row_blocks(rows: DataFrame) -> DataFrame:
    """``(dim, block, n, body)`` without angles, at most ``BLOCK`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: dict[int, list] = {}

        def packed(dim: int, n: int) -> pa.RecordBatch:
            ids, labels, q = (np.concatenate(x) for x in zip(*open_rows.pop(dim)))
            if len(ids) > n:
                open_rows[dim] = [(ids[n:], labels[n:], q[n:])]
            q = q[:n]
            body = Rows(ids[:n], labels[:n], q, _norms(q), np.zeros((n, 0))).to_bytes()
            columns = [pa.array([dim], pa.int32()), pa.array([n], pa.int32()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dim", "n", "body"])

        for batch in batches:
            for dim, ids, labels, q in _arrays(batch):
                open_rows.setdefault(dim, []).append((ids, labels, q))
                while sum(len(x[0]) for x in open_rows.get(dim, ())) >= BLOCK:
                    yield packed(dim, BLOCK)
        for dim in list(open_rows):
            yield packed(dim, sum(len(x[0]) for x in open_rows[dim]))

    found = rows.mapInArrow(run, "dim int, n int, body binary")
    # The task's number and the block's within it, so that a row's number fits in 64 bits too.
    number = F.monotonically_increasing_id()
    block = F.shiftleft(F.shiftright(number, 33), 22) + number % (1 << 22)
    return found.select("dim", block.alias("block"), "n", "body")


def with_angles(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Blocks whose rows store their angles, in order of the first.  That is the reference
    to which the block's angles differ most; the block's columns keep one order otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows.from_bytes(row["body"], row["n"], row["dim"])
                directions = np.frombuffer(row["refs"], np.float64).reshape(-1, row["dim"]) if row["dim"] else np.zeros((1, 0))
                rows.angles = angles_to(rows.q, rows.norms, directions)
                rows = rows.take(np.argsort(rows.angles[:, rows.angles.std(axis=0).argmax()], kind="stable"))
                columns = [pa.array([row["dim"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([row["n"]], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([rows.to_bytes()], pa.binary())], ["dim", "block", "n", "body"])

    return blocks.join(common.small(refs.select("dim", F.col("body").alias("refs"))), "dim", "left").mapInArrow(run, ROW_SCHEMA)


def anchor_rows(blocks: DataFrame) -> DataFrame:
    """``(dim, anchor, body)``, one row per anchor; ``anchor`` is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows.from_bytes(row["body"], row["n"], row["dim"])
                at = np.flatnonzero(rows.ids % ANCHOR_EVERY == 0)
                bodies = [rows.take(at[k : k + 1]).to_bytes() for k in range(len(at))]
                columns = [
                    pa.array(np.full(len(at), row["dim"], np.int32)), pa.array(row["block"] * BLOCK + at, pa.int64()), pa.array(bodies, pa.binary())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "anchor", "body"])

    return blocks.mapInArrow(run, "dim int, anchor long, body binary")


def meetings(blocks: DataFrame, anchors: DataFrame, count: int) -> DataFrame:
    """Every block of rows beside every block of anchors of its length: ``anchors (dim, anchor,
    body, ...)`` are gathered ``ANCHORS`` at a time, and a block of them has ``SALTS`` tasks."""
    groups = max(1, -(-count // ANCHORS))
    more = [c for c in anchors.columns if c not in ("dim", "anchor", "body")]
    entry = F.struct("anchor", "body", *more)
    gathered = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    gathered = gathered.groupBy("dim", "group").agg(F.sort_array(F.collect_list(entry)).alias("anchors"))
    dealt = gathered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.join(dealt, ["dim", "group", "salt"])


# ---- bounds and scores ---------------------------------------------------


def reach(blocks: Rows, order: int, anchor: np.ndarray, least_cosine: float) -> tuple[int, int]:
    """The stretch of a block that can have that cosine, by its ordered angles alone."""
    widest = math.acos(max(-1.0, min(1.0, least_cosine))) + ANGLE_SLACK
    angles = blocks.angles[:, order]
    first = np.searchsorted(angles, anchor[order] - widest, "left")
    return int(first), int(np.searchsorted(angles, anchor[order] + widest, "right"))


def score_bounds(angles: np.ndarray, norms: np.ndarray, anchor: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each row with the anchor, rounding included."""
    apart = np.abs(angles - anchor).max(axis=1) - ANGLE_SLACK
    total = angles + anchor
    along = np.minimum(total, 2 * np.pi - total).min(axis=1) + ANGLE_SLACK
    high = np.cos(np.clip(apart, 0, np.pi))
    low = np.cos(np.clip(along, 0, np.pi))
    scale = norms * norm
    slack = 1 + scale * 1e-9
    low, high = low * scale - slack, high * scale + slack
    # Norms too large for a double bound nothing.
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def scores(q: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles if all sums fit these, else by Python's integers."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if np.abs(q).max() * np.abs(anchor).max() * len(anchor) < EXACT:
        return (q @ anchor).astype(np.int64)
    a = [int(x) for x in anchor]
    exact = [sum(int(x) * y for x, y in zip(row, a)) for row in q]
    return np.array(exact, np.int64 if all(-(1 << 63) <= s < 1 << 63 for s in exact) else object)


class Best:
    """The first rows by score, then by id, of those offered."""

    def __init__(self, places: int):
        self.places, self.ids, self.scores = places, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self):
        """The score below which nothing can come in."""
        return self.scores[-1] if len(self.scores) == self.places else None

    def offer(self, ids: np.ndarray, found: np.ndarray) -> None:
        ids, found = np.concatenate([self.ids, ids]), np.concatenate([self.scores, found])
        first = np.lexsort((ids, -found))[: self.places]
        self.ids, self.scores = ids[first], found[first]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Rows, int]]:
    """Each meeting with its rows and the reference they are ordered by."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            rows = Rows.from_bytes(row["body"], row["n"], row["dim"])
            yield row, rows, int(rows.angles.std(axis=0).argmax())


def _candidates(rows: Rows, order: int, anchor: Rows, wanted: np.ndarray, floor, tests) -> np.ndarray:
    """Rows among ``wanted`` whose bounds pass ``tests``, after those that cannot reach the
    score ``floor`` by the ordered reference are cut off on both sides."""
    first, last = 0, len(rows)
    largest = float(rows.norms.max() * anchor.norms[0])
    if floor is not None and largest > 0 and floor > 0:
        first, last = reach(rows, order, anchor.angles[0], (float(floor) - 1) / largest - 1e-9)
    at = np.flatnonzero(wanted[first:last]) + first
    if not len(at):
        return at
    low, high = score_bounds(rows.angles[at], rows.norms[at], anchor.angles[0], anchor.norms[0])
    return at[tests(low, high)]


def _long(values) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())


def positives(meeting: DataFrame, places: int = POSITIVES) -> DataFrame:
    """``(dim, anchor, anchor_id, positive_id, positive_score, rank)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, Best]] = {}
        for row, rows, order in _met(batches):
            for entry in row["anchors"]:
                one = Rows.from_bytes(entry["body"], 1, row["dim"])
                _, top = best.setdefault((row["dim"], entry["anchor"]), (int(one.ids[0]), Best(places)))
                wanted = rows.labels == one.labels[0]
                # The anchor itself is the row of its id, label and vector.
                wanted &= (rows.ids != one.ids[0]) | (rows.q != one.q[0]).any(axis=1)
                floor = top.floor()
                at = _candidates(rows, order, one, wanted, floor, lambda low, high, f=floor: high >= (-np.inf if f is None else float(f)))
                if len(at):
                    top.offer(rows.ids[at], scores(rows.q[at], one.q[0]))
        for (dim, anchor), (own, top) in best.items():
            n = len(top.ids)
            columns = [pa.array([dim] * n, pa.int32()), _long([anchor] * n), _long([own] * n), _long(top.ids), _long(top.scores)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "anchor", "anchor_id", "positive_id", "positive_score"])

    found = meeting.mapInArrow(run, "dim int, anchor long, anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("dim", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= places)


def negatives(meeting: DataFrame, places: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; anchors
    come with ``positives``, structs of rank, positive_id and positive_score."""
    names = ["dim", "anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, list]] = {}
        for row, rows, order in _met(batches):
            for entry in row["anchors"]:
                one = Rows.from_bytes(entry["body"], 1, row["dim"])
                key = (row["dim"], entry["anchor"])
                if key not in best:
                    windows = [(p, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100, Best(places)) for p in entry["positives"]]
                    best[key] = (int(one.ids[0]), [w for w in windows if w[1] <= w[2]])
                windows = best[key][1]
                if not windows:
                    continue
                # A full window takes only scores from its last place on.
                spans = [(a if top.floor() is None else max(a, top.floor()), b) for _, a, b, top in windows]

                def overlaps(least, most, spans=spans):
                    return np.logical_or.reduce([(most >= float(a)) & (least <= float(b)) for a, b in spans])

                at = _candidates(rows, order, one, rows.labels != one.labels[0], min(a for a, _ in spans), overlaps)
                if not len(at):
                    continue
                found = scores(rows.q[at], one.q[0])
                for (a, b), (_, _, _, top) in zip(spans, windows):
                    inside = (found >= a) & (found <= b)
                    if inside.any():
                        top.offer(rows.ids[at[inside]], found[inside])
        for (dim, anchor), (own, windows) in best.items():
            for p, _, _, top in windows:
                n = len(top.ids)
                fixed = [dim, anchor, p["rank"], own, p["positive_id"], p["positive_score"]]
                columns = [pa.array([dim] * n, pa.int32()), *[_long([x] * n) for x in fixed[1:]], _long(top.ids), _long(top.scores)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} {'int' if n == 'dim' else 'long'}" for n in names)
    found = meeting.mapInArrow(run, schema)
    first = Window.partitionBy("dim", "anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= places)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", label: Column | None = None
) -> DataFrame:
    """Hard negatives of every anchor's positives; ``label`` may change the labels by an
    expression over ``vec_id`` and ``label``."""
    rows = usable(vectors, id_col, label_col, vector_col)
    rows = common.stored(rows if label is None else rows.withColumn("label", label.cast("long")), "vectors")
    refs = common.stored(references(rows), "references")
    blocks = common.stored(with_angles(common.stored(row_blocks(rows), "blocks"), refs), "angles")
    anchors = common.stored(anchor_rows(blocks), "anchors")
    count = anchors.count()
    near = common.stored(positives(meetings(blocks, anchors, count)), "positives")
    listed = near.groupBy("dim", "anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")
    )
    return negatives(meetings(blocks, anchors.join(listed, ["dim", "anchor"]), count))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives over all embeddings, a seventh of them with the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), label=moved)


ORACLE = f"""
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
           cast(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) as bigint) as score
    from rows a, rows r where a.vec_id % {ANCHOR_EVERY} = 0 and r.vec_id <> a.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
found as (
    select p.*, s.vec_id as negative_id, s.score as negative_score,
           row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
    from positives p join scored s using (anchor_id)
    where not s.same and {LOW} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from found where rank <= {NEGATIVES}"""
