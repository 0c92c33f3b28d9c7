"""Operator 4: toxic passages as maximum-scoring segments of token log-odds.

Units are lower-cased words and their first five characters (``PREFIX``); a word that was
not met in training is judged by its beginning.  A unit's weight is its log-odds between
toxic and clean training documents under an informative Dirichlet prior: ``PRIOR`` times
the unit's count in both classes together is added to each; only units whose log-odds are
``MIN_Z`` standard deviations from zero have one.  Each word scores its weight minus
``DRIFT``, so clean text sinks.  The linear-time scan of Ruzzo and Tompa finds all maximal
segments.  Under the clean word distribution segment scores follow an extreme-value law:
``lam`` solves sum p exp(lam s) = 1 and K is fitted to the best segments of clean training
documents, so a segment of score S in n words has E-value K n exp(-lam S).  A passage is
significant if that is at most ``MAX_E``.  A document's evidence is the sum over its
significant passages, or its best segment, of -ln E, and a logistic curve fitted to the
training documents turns it into a score between 0 and 1.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, those of the least
hashes, and keeps at most ``MODEL_UNITS`` weights, so it has a bounded size.  Everything
else reads all documents.

Defined cases: a null or empty text, or one without words, has no passage and the score of
no evidence; a row without id is scored and not held out; a label without text or value
is not used; repeated rows each give a row; without two classes in training every score
is the share of toxic documents (0 without any); other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common

TRAIN_ROWS, MODEL_UNITS = 20_000, 50_000
PREFIX, PRIOR, MIN_Z, DRIFT, MAX_E = 5, 0.05, 2.3, 1.0, 0.01
THRESHOLD = 0.7
MEMO = 300_000
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


@dataclass
class Model:
    """Weights of units and the calibration of segment scores."""

    weights: dict[str, float]
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    bias: float = 0.0
    memo: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        """Score of one word: its weight, else that of its beginning, less the drift."""
        weight = self.weights.get(word)
        if weight is None:
            weight = self.weights.get(word[:PREFIX] + "*", 0.0) if len(word) > PREFIX else 0.0
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[word] = weight - DRIFT
        return weight - DRIFT

    def scores(self, words: list[str]) -> np.ndarray:
        get, new = self.memo.get, self.word
        found = [get(w) for w in words]
        if None in found:
            found = [new(w) if s is None else s for w, s in zip(words, found)]
        return np.array(found, np.float64)

    def log_e(self, score: float, n: int) -> float:
        """Logarithm of the expected number of segments as good in n clean words."""
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def evidence(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence of a document, and its significant passages (first word, end, score)."""
        found = segments(self.scores(words))
        if not found:
            return -self.log_e(0.0, len(words)), []
        n = len(words)
        passages = [s for s in found if self.log_e(s[2], n) <= math.log(MAX_E)]
        if passages:
            return sum(-self.log_e(s[2], n) for s in passages), passages
        return -self.log_e(max(s[2] for s in found), n), []

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.bias + self.slope * squashed(evidence)))))


def squashed(evidence):
    """Evidence on a scale on which a long toxic document does not outweigh all others."""
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in order: (first, end, score).  Each positive score
    starts as a segment of its own; ``below[k]`` is the nearest kept segment whose left
    sum is less than that of k, so the search for it follows a chain and the whole is linear."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.r_[0.0, np.cumsum(scores)]
    first: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    below: list[int] = []
    for i in positive.tolist():
        a, b, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(first) - 1
            while j >= 0 and low[j] >= left:
                j = below[j]
            if j < 0 or high[j] >= right:
                first.append(a)
                end.append(b)
                low.append(left)
                high.append(right)
                below.append(j)
                break
            a, left = first[j], low[j]
            del first[j:], end[j:], low[j:], high[j:], below[j:]
    return [(a, b, h - x) for a, b, x, h in zip(first, end, low, high)]


def is_held_out(id_col: str = "doc_id"):
    """Documents that no model may learn from: a third, by a hash of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(text, toxic)`` of at most ``rows`` labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = common.stored(chosen, "labelled")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _unit_counts(train: DataFrame) -> DataFrame:
    """``(unit, toxic, clean)``: documents of each class that have the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(words_of(text))
                words |= {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}
                counts[toxic == 1].update(words)
            units = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(units, pa.string())] + [pa.array([c[u] for u in units], pa.int64()) for c in counts[::-1]]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "toxic", "clean"])

    counted = train.mapInArrow(run, "unit string, toxic long, clean long")
    return counted.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model; the driver gets at most ``MODEL_UNITS`` weights and two numbers for each
    training document."""
    train = common.stored(training_rows(docs, labels, rows), "training")
    counts = common.stored(_unit_counts(train), "units")
    total = counts.where(~F.col("unit").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = (float(x or 0) for x in total)
    share = train.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    if not n1 or not n0:
        return Model({}, bias=math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0))

    prior, whole = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")), PRIOR * (n1 + n0)
    odds = F.log((F.col("toxic") + prior) / (n1 + whole)) - F.log((F.col("clean") + prior) / (n0 + whole))
    deviation = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    weighed = counts.where("toxic + clean > 1").select("unit", "clean", odds.alias("weight"), (odds / deviation).alias("z"))
    kept = weighed.where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "unit").limit(MODEL_UNITS).collect()
    model = Model({r["unit"]: r["weight"] for r in kept})

    # The clean distribution of word scores: kept words by their smoothed share, the rest
    # at minus the drift.
    words = [r for r in kept if not r["unit"].endswith("*")]
    p = np.array([(r["clean"] + 0.5) / (n0 + 0.5 * len(words)) for r in words] + [0.0])
    s = np.array([r["weight"] - DRIFT for r in words] + [-DRIFT])
    p[-1] = max(0.0, 1.0 - p.sum())
    model.lam = _root(p, s)

    gathered = train.mapInArrow(_evidence_rows(model), "best double, n long, toxic int").collect()
    best, n, toxic = (np.array([r[k] for r in gathered], np.float64) for k in range(3))
    clean = (toxic == 0) & (n > 0)
    if clean.any():
        # The mean of the extreme-value law is its place plus Euler's constant.
        model.log_k = float(np.mean(model.lam * best[clean] - np.log(n[clean]))) - 0.5772156649
    model.slope, model.bias = _logistic(*_train_evidence(train, model))
    return model


def _root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive solution of sum p exp(lam s) = 1, by halving."""
    if not (s > 0).any() or float((p * s).sum()) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while float((p * np.exp(np.minimum(high * s, 700))).sum()) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if float((p * np.exp(np.minimum(middle * s, 700))).sum()) < 1 else (low, middle)
    return (low + high) / 2


def _evidence_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, n = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                found = segments(model.scores(words))
                best.append(max((f[2] for f in found), default=0.0))
                n.append(len(words))
            toxic = pa.array([int(t == 1) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), toxic], ["best", "n", "toxic"])

    return run


def _train_evidence(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(words_of(t))[0] for t in batch.column(0).to_pylist()]
            toxic = pa.array([int(t == 1) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), toxic], ["evidence", "toxic"])

    rows = train.mapInArrow(run, "evidence double, toxic int").collect()
    return squashed(np.array([r[0] for r in rows])), np.array([r[1] for r in rows], np.float64)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and bias by Newton's method; the ridge keeps separable data finite."""
    design = np.c_[x, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, passages)`` per row; a passage is ``first`` and ``end`` word, score and
    logarithm of its E-value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_e", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                scores, found = [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    evidence, passages = model.evidence(words)
                    scores.append(model.probability(evidence))
                    found.append(
                        [{"first": a, "end": b, "score": s, "log_e": model.log_e(s, len(words))} for a, b, s in passages]
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(passage))],
                    ["id", "score", "passages"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        run, f"id {kind}, score double, passages array<struct<first:int,end:int,score:double,log_e:double>>"
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            clean = [model.probability(model.evidence(words_of(t))[0]) < THRESHOLD for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text; a third of the ids is never learnt from."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return toxic_passages(docs, model).select(
        F.col("id").alias("doc_id"),
        is_held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
