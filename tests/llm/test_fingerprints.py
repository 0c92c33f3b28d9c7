"""Operator 7 against a plain restatement of its definition."""

import hashlib

import numpy as np

from sealtable.llm import common, fingerprints as fp


def plain_anchors(data: bytes):
    def inner(i):
        word = np.array([int.from_bytes(data[i : i + fp.S], "little")], np.uint64)
        return int(common.mixed(word)[0])

    out = []
    for i in range(len(data) - fp.K + 1):
        hashes = [inner(i + j) for j in range(fp.K - fp.S + 1)]
        if min(hashes) in (hashes[0], hashes[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers(monkeypatch):
    data = ("the quick brown fox jumps over the lazy dog again and again " * 5 + "aaaaaaaaaaaaaaaaaaaaaaaaaaaa").encode()
    places, hashes = fp.anchors(np.frombuffer(data, np.uint8))
    assert places.tolist() == plain_anchors(data)
    assert len(set(zip((data[p : p + fp.K] for p in places), hashes.tolist()))) == len(set(hashes.tolist()))
    monkeypatch.setattr(common, "SLICE", 37)
    again = fp.anchors(np.frombuffer(data, np.uint8))
    assert again[0].tolist() == places.tolist() and (again[1] == hashes).all()


def brute(rows):
    """Every row with its next one, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, after = (fp.fingerprint(t.encode()) for t in (text, new, following))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fp._hex(own), fp._hex(other),
                    fp.likeness(own, other), fp.likeness(own, after)))
    return out


def test_next_document_over_any_number_of_ranges(spark):
    rows = [(i * i, f"text {i} " * (i % 13)) for i in range(300)] + [(None, "no id"), (7, None), (-5, "ä漢😀" * 40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    want = brute(rows)
    for parts in (1, 2, 50):
        got = sorted(map(tuple, fp.edit_likeness(docs, parts).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == want


def test_small_tables(spark):
    one = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in fp.edit_likeness(one).collect()] == [(5, 1.0)]
    assert fp.edit_likeness(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "same"), (5, "same")], "doc_id long, text string")
    assert [r.near_next for r in fp.edit_likeness(twice).collect()] == [1.0, 1.0]


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(d.doc_id, d.text) for d in common.table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, fp.op7_fingerprints(spark, sf_dir).collect()))
    assert got == brute(rows)
