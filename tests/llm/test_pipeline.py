"""The pipeline's stages against plain versions, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute
from test_packing import whole
from test_substrings import searched

import __spark_entry__ as entry_point
import corpus_pipeline
from sealtable.llm import common, toxicity
from sealtable.session import work_path


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = prose(80)
    texts = [prose(rng.randrange(20, 150)) for _ in range(150)]
    for k in range(30):
        texts.append(" ".join([*texts[k].split()[:-1], rng.choice(words)]))
        texts.append(texts[k])
        texts.append(f"{prose(30)} {passage} {prose(30)}")
        texts.append(f"{prose(20)} vile rotten vile {prose(10)} rotten vile {prose(20)}")
        texts.append(f"{prose(20)} vile rotten vile rotten {prose(20)}")
    texts += [None, "", "one"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts)]
    path = work_path(spark, "tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string")
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    names = docs.columns
    for (name, stage), expect in zip(corpus_pipeline.STAGES, (clean, one_of_each, without_passages, packed)):
        out = common.stored(stage(spark, docs, folder), name)
        if expect is not packed:
            assert out.columns == names
        expect(docs.collect(), out.collect())
        docs = out
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def clean(before, after):
    assert {r.doc_id for r in after} == {r.doc_id for r in before if "vile" not in (r.text or "")}
    assert set(after) <= set(before)


def one_of_each(before, after):
    component = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))
    assert set(after) <= set(before)


def without_passages(before, after):
    want = searched([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: (r.text or "").split() for r in after} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    assert sum((r.text or "").split() != want[r.doc_id] for r in before) >= 20


def packed(before, after):
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    whole(after, 2048)


def test_edge_rows(spark, folder):
    """Nulls in every column, repeated rows and an empty table go through all stages."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words that stand here twice and again"
    rows = [(None,) * 5, (1, None, None, None, None), (2, text, "en", "a", 3), (2, text, "en", "a", 3), (3, "", "", "", 0)]
    for count, expected in ((5, [None, 1, 2, 3]), (0, [])):
        docs = spark.createDataFrame(rows[:count], kind)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, folder), name)
        assert sorted((r.doc_id for r in docs.collect()), key=lambda i: i or 0) == expected


def test_registration():
    names = entry_point.queries()
    assert "pipeline" in names and sorted(n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()) == sorted(
        f"op{k}" for k in range(1, 14)
    )
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and toxicity.THRESHOLD == 0.7


def test_columns_of_clashing_names(spark, folder):
    docs = common.table(spark, folder, "documents").withColumns({"n_chunks": F.lit("a"), "removed": F.lit("b")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        docs = out
    assert {(r.n_chunks, r.removed) for r in docs.collect()} == {("a", "b")}
