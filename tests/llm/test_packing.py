"""Operator 10: pieces equal the library's ids, bins hold them without gaps."""

import collections
import zlib

import numpy as np
import pytest
import public_tokenizers
import tokenizers

from sealtable.llm import common, packing


def sequences(rows):
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    return held


def whole(rows, capacity):
    """Every sequence is gapless from 0 and not over its capacity."""
    for places in sequences(rows).values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op10_packing(spark, sf_dir).collect()
    by = collections.defaultdict(dict)
    for r in rows:
        by[r.doc_id][r.piece] = r
    total = 0
    for doc in common.table(spark, sf_dir, "documents").collect():
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for number in range(len(by[doc.doc_id])):
            r = by[doc.doc_id][number]
            assert r.start == at and (number == 0 or r.length == 2048)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids) and (len(ids) > 2048 or len(by[doc.doc_id]) == 1)
    whole(rows, 2048)
    assert len(sequences(rows)) <= -(-total // 2048) * 1.01


@pytest.mark.parametrize("node_rows, carry", [(10000, 100), (100, 5), (30, 2), (20, 1)])
def test_tree_of_nodes_keeps_every_piece(spark, node_rows, carry):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1, 101, 2000))]
    cut = spark.createDataFrame(rows + rows[:5], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(cut, 100, node_rows, 4, carry, 0).collect()
    assert sorted(r[:5] for r in out) == sorted(map(tuple, cut.collect()))
    whole(out, 100)
    if node_rows == 10000:
        assert len(sequences(out)) <= sum(r[3] for r in rows + rows[:5]) / 100 * 1.05 + 1


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit(np.array([60, 50, 40, 50]), 100)
    assert bins.tolist() == [0, 1, 0, 1] and places.tolist() == [0, 0, 60, 50] and fills.tolist() == [100, 100]


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "", "x"), (3, "w " * 5000, "x"), (4, "<|endoftext|>", "x")],
        "doc_id long, text string, length string",
    )
    rows = packing.pack_documents(docs).collect()
    whole(rows, 2048)
    lengths = collections.Counter((r.doc_id, r.length) for r in rows)
    assert lengths[1, 1] == 1 and lengths[2, 1] == 2 and lengths[None, 3] == 1 and lengths[4, 2] == 1
    assert sum(r.length for r in rows if r.doc_id == 3) in (5001, 5002, 10001, 10002)
    assert packing.pack_documents(docs.limit(0)).count() == 0
