"""Operator 12 against a tree built plainly, for many sizes and steps."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sealtable.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place string, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, source, lang, n_chars, text):
    return H(*[part(v) for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def way(levels, k):
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append((other < k, level[other] if other < len(level) else None))
        k >>= 1
    return out


def fold(node, steps):
    for left, other in steps:
        node = H(node) if other is None else H(other, node) if left else H(node, other)
    return node


def plain(rows):
    """Rows of the contract, in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(*r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for rows_of in groups.values():
        rows_of.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: climb([d for _, d in groups[g]]) for g in names}
    crown = climb([trees[g][-1][0] for g in names])
    out = []
    for number, g in enumerate(names):
        for k, (r, digest) in enumerate(groups[g]):
            steps = way(trees[g], k) + way(crown, number)
            doc, source, lang, n, text = r
            seen = digest
            if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None:
                seen = leaf(doc, source, lang, n + 1, text)
            root = crown[-1][0]
            end = fold(seen, steps)
            proof = H(*[d for _, d in steps if d is not None])
            out.append((doc, digest, trees[g][-1][0], root, proof, end, end == root))
    return sorted(out, key=repr)


def query(spark, rows, step):
    docs = spark.createDataFrame([(*r, "t", "p", "g") for r in rows], SCHEMA)
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    other = merkle.row_digest({**columns, "n_chars": F.col("n_chars") + 1})
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.unhex(merkle.row_digest(columns)).alias("digest"),
        F.unhex(F.when(hit & F.col("n_chars").isNotNull(), other)).alias("tampered"),
    )
    found = merkle.manifest(leaves, step)
    text = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "root", "tampered")}
    out = found.select(
        "id", text["digest"], text["subroot"], text["root"], merkle.proof_digest(F.col("siblings")),
        merkle.folded(F.coalesce(text["tampered"], text["digest"]), F.col("siblings")),
    ).collect()
    return sorted([(*r, r[5] == r[3]) for r in out], key=repr)


def made(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for g, size in sizes.items():
        for _ in range(size):
            rows.append((rng.randrange(10_000), rng.choice(["a", "é", None, ""]), g, rng.choice([None, 5, 70]), "x" * rng.randrange(50)))
    return rows


@pytest.mark.parametrize("step", [1, 2, 3, 10])
def test_every_size_and_step(spark, step):
    rows = made({"en": 37, "de": 8, "fr": 1, "es": 2, "it": 5, None: 16, "": 3, "é": 9, "z": 4})
    assert query(spark, rows, step) == plain(rows)


def test_one_group_holds_most_rows(spark):
    rows = made({"en": 1500, "de": 3}, seed=2)
    rows += [(7, "s", "en", 1, "same")] * 700 + [(None, None, "en", None, None)] * 40
    assert query(spark, rows, 4) == plain(rows)


def test_one_row_and_none(spark):
    one = [(7, "s", "en", 3, "only")]
    assert query(spark, one, 3) == plain(one)
    assert query(spark, [], 3) == []


def test_very_long_text(spark):
    rows = [(1, "s", "en", 3_000_000, "é" * 3_000_000), (2, "s", "en", 0, ""), (3, "s", "en", None, None)]
    assert query(spark, rows, 2) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.COLUMNS).collect()]
    got = sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_only_checkpoints_are_written(spark):
    leaves = spark.range(1000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("place"), F.lit(1000).cast("long").alias("size"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    levels = merkle.written_levels(leaves, 4)
    assert [level.count() for level in levels] == [1000, 63, 4, 1]
