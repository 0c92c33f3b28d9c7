"""Operator 3 against all pairs."""

import random
import re

import pytest

from sealtable.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, groups=12, size=12):
    """Groups of near copies with a few to many edits each, chains, one common line."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(600)]
    line = " ".join(words[:30])
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
            rows.append((len(rows), (line + " " if rng.random() < 0.3 else "") + " ".join(text)))
    chain = [rng.choice(words) for _ in range(100)]
    for k in range(20):
        rows.append((len(rows), " ".join(chain[k : k + 80])))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b"), (1004, "a\tB"), (1005, "a b c"), (1006, "x " * 5000)]


@pytest.mark.parametrize("seed, rows_of_a_list", [(1, 1024), (2, 4), (3, 1)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, rows_of_a_list):
    """Also with lists dealt into many parts."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", rows_of_a_list)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, sig int, g int")
    got = jaccard.similar_components(docs.repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bad_estimates_lose_nothing(spark, monkeypatch):
    """Order and dealing by a sketch in which everything collides."""
    monkeypatch.setattr(jaccard, "rarity", lambda blocks: jaccard.np.full(jaccard.COUNTERS, 14, jaccard.np.uint8))
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_components(docs).collect())) == brute(rows)


def test_edge_rows(spark):
    text, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    rows = [(5, text), (5, text), (5, other), (8, other), (None, text), (9, None), (3, text)]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Different texts under id 5 link it with both.
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [
        (3, 46, 3), (5, 46, 3), (5, 46, 3), (5, 46, 3), (8, 46, 3), (9, 0, 9)
    ]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(46, None)]
    assert jaccard.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_patterned_words_are_not_alike(spark):
    from test_substrings import thue_morse

    one = thue_morse(2048)
    two = one.translate(str.maketrans("th", "ht"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} and four more words"), (4, f"{two} and four more words")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_components(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4}


def test_only_what_may_be_similar_is_read_into_sets(spark, monkeypatch):
    """Texts that share a passage are pairs of the lists, but not similar: no set of theirs is
    written, no text is shuffled, and no shuffle outlives its query."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(i, f"{passage} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))) for i in range(60)]
    rows += [(100 + i, f"{t} more") for i, t in rows[:3]]
    docs = jaccard.common.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "docs")
    written, joined = [], []

    def stored(df, label, was=jaccard.common.stored):
        out = was(df, label)
        if label == "sets":
            joined.append(re.findall("Exchange|Join", df._jdf.queryExecution().executedPlan().toString()))
            written.append(out.count())
        return out

    def shuffled():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(kept.size()) if (name := kept.apply(k).getName()).startswith("shuffle")}

    monkeypatch.setattr(jaccard.common, "stored", stored)
    monkeypatch.setattr(jaccard.common, "BROADCAST_ROWS", 0)
    # In the order of their hashes, common shingles come as early as rare ones.
    monkeypatch.setattr(jaccard, "rarity", lambda blocks: jaccard.np.zeros(jaccard.COUNTERS, jaccard.np.uint8))
    before = shuffled()
    got = jaccard.similar_components(docs)
    monkeypatch.undo()
    assert not shuffled() - before
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert written == [6, 0]
    assert joined == [[], []]


def test_a_pair_is_left_out_only_if_it_cannot_be_similar():
    """Sets of all sizes, also those that need buckets of another number."""
    rng = jaccard.np.random.default_rng(6)

    def may(a, b):
        return jaccard._may_link(len(a), jaccard._odd(a), len(b), jaccard._odd(b))

    for n in (1, 2, 7, 60, 64, 65, 127, 130, 1000, 1030, 5000):
        a = jaccard.np.unique(rng.integers(0, 1 << 64, n, dtype=jaccard.np.uint64))
        for gone, new in ((0, 0), (n // 4, 0), (0, n // 3), (n // 7, n // 7), (n // 8, n // 10)):
            b = jaccard.np.union1d(a[gone:], rng.integers(0, 1 << 64, new, dtype=jaccard.np.uint64))
            both = len(jaccard.np.intersect1d(a, b))
            assert 100 * both >= 75 * (len(a) + len(b) - both)
            assert may(a, b) and may(b, a)
        if n >= 60:
            other = rng.integers(0, 1 << 64, n, dtype=jaccard.np.uint64)
            half = jaccard.np.union1d(a[: n // 2], other[n // 2 :])
            assert not may(a, jaccard.np.unique(other)) and not may(a, half)
