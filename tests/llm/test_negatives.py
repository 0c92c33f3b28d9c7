"""Operator 13 against all scores, and what its bounds promise."""

import math

import numpy as np
from pyspark.sql import functions as F

from sealtable.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, anchor string, dim string"


def brute(rows):
    seen = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[(vec_id, tuple(v), label)] = (vec_id, [math.floor(256 * x) for x in v], label)
    rows = list(seen.values())
    out = []
    for anchor in rows:
        if anchor[0] % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(anchor[1], r[1])), r[0], r[2]) for r in rows if r != anchor and len(r[1]) == len(anchor[1])
        ]
        scored.sort()
        for p, pid, _ in [s for s in scored if s[2] == anchor[2]][:5]:
            fit = [s for s in scored if s[2] != anchor[2] and -80 * p <= -100 * s[0] <= -100 * p]
            out += [(anchor[0], pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit[:5])]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **how).collect())


def clustered(seed, n, dim=24, groups=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 2
    rows = []
    for i in range(n):
        g = int(rng.integers(groups))
        v = (centres[g] + rng.standard_normal(dim) * rng.uniform(0.1, 1)) * rng.uniform(0.01, 3)
        rows.append((i, [float(x) for x in v], g if i % 9 else (g + 1) % groups))
    return rows


def test_clusters_of_any_norm(spark):
    rows = clustered(1, 3000)
    assert got(spark, rows) == brute(rows)


def test_one_label_holds_most_rows_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)], int(rng.integers(3))) for i in range(1000)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 1) for i in range(600)]
    assert got(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(3, 400, dim=4, groups=3)
    rows += [(500, None, 1), (600, [1.0, None, 0.0, 0.0], 1), (700, [nan, 0.0, 0.0, 0.0], 1), (800, [inf, 0.0, 0.0, 0.0], 1)]
    rows += [(900, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 4.0], 1), (1000, [0.0] * 4, 1), (1100, [], 1), (1200, [], 2)]
    rows += [(1300, [5.0], 1), (1301, [4.0], 1), (1302, [4.5], 2), (1303, [4.25], 2)]
    rows += rows[:50] + [(100, [9.0, 9.0, 9.0, 9.0], 2)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 5) + 0.5], int(rng.integers(2))) for i in range(300)]
    assert got(spark, rows) == brute(rows)


def test_labels_by_an_expression(spark):
    rows = clustered(5, 600, groups=10)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert got(spark, rows, label=moved) == brute([(i, v, (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in rows])


def test_several_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = clustered(6, 1500)
    assert got(spark, rows) == brute(rows)


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(7)
    rows = clustered(7, 2000)
    q = np.floor(np.array([r[1] for r in rows]) * 256)
    labels = np.array([r[2] for r in rows])
    norms = negatives._norms(q)
    means = np.stack([(q / norms[:, None])[labels == g].mean(axis=0) for g in range(8)])
    angles = negatives.angles_to(q, norms, means / negatives._norms(means)[:, None])
    spared = total = 0
    for k in rng.integers(0, len(q), 50):
        low, high = negatives.score_bounds(angles, norms, angles[k], norms[k])
        exact = q @ q[k]
        assert (low <= exact).all() and (exact <= high).all()
        best = np.sort(exact[labels == labels[k]])[-6]
        spared += int((high < 0.8 * best).sum())
        total += len(q)
    assert spared > 0.5 * total
