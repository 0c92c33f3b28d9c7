"""Many search strings at once against one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from sealtable.operators import patterns as pt


def successive(text, rows):
    for mark, value, first_only in rows:
        if text is not None and mark:
            text = text.replace(mark, value or "", 1 if first_only else -1)
    return text


def filled(spark, texts, rows, **how):
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "id int, text string, mark string")
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position int, mark string, value string, once boolean")
    out = pt.filled_from(df, "text", table.repartition(3), first_only="once", **how)
    assert out.columns == df.columns
    return [r.text for r in out.orderBy("id").collect()]


def test_order_keeps_its_meaning(spark):
    rows = [("A", "B", False), ("B", "C", False), ("xy", "", False), ("aa", "a", True), ("", "never", False), (None, "never", False), ("A", "late", False), ("C", None, True)]
    texts = ["A B", "xxyy", "aaaa", "", None, "ABCABC", "éA漢"]
    assert filled(spark, texts, rows) == [successive(t, rows) for t in texts]


def test_ten_thousand_placeholders(spark):
    rng = random.Random(1)
    letters = "abcd"
    rows = []
    for _ in range(10_000):
        mark = "".join(rng.choices(letters, k=rng.randrange(3, 9)))
        rows.append((mark, "".join(rng.choices(letters + "-", k=rng.randrange(0, 7))), rng.random() < 0.1))
    texts = ["".join(rng.choices(letters + " ", k=rng.randrange(0, 80))) for _ in range(60)]
    assert filled(spark, texts, rows) == [successive(t, rows) for t in texts]


def test_plan_does_not_grow_with_the_list(spark):
    df = spark.createDataFrame([("x",)], "text string")
    sizes = set()
    for n in (1, 1000, 10_000):
        rows = spark.range(n).select(F.col("id").alias("position"), F.concat(F.lit("MARK_"), "id").alias("mark"), F.lit("v").alias("value"))
        sizes.add(len(pt.filled_from(df, "text", rows)._jdf.queryExecution().optimizedPlan().toString()) // 100)
    assert len(sizes) == 1


def test_lines_with_any_of_many_strings(spark):
    rng = random.Random(2)
    needles = sorted({"".join(rng.choices("abc", k=rng.randrange(4, 8))) for _ in range(3000)})[::3]
    lines = ["".join(rng.choices("abcd ", k=rng.randrange(0, 30))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    table = spark.createDataFrame([(n,) for n in [*needles, "", needles[0]]] + [(None,)], "needle string")
    want = [k for k, t in enumerate(lines) if t is not None and any(n in t for n in needles)]
    assert sorted(r.id for r in pt.containing_any(df, table).collect()) == want
    found = {r.id: r.found for r in pt.found_strings(df, table).collect()}
    assert found == {k: None if t is None else [n for n in needles if n in t] for k, t in enumerate(lines)}
    assert pt.containing_any(df, table.limit(0)).collect() == []


def test_a_list_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(pt, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        filled(spark, ["a"], [("x" * 200, "y", False)])
