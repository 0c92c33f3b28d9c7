"""Operator 9: the permutation, the stream, and reads from any slot."""

import glob
import zlib

import numpy as np
import pytest

from sealtable.llm import common, library, shards
from sealtable.session import work_path


@pytest.mark.parametrize("domain", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(domain):
    got = shards.permuted(np.arange(domain), domain, 7)
    assert sorted(got.tolist()) == list(range(domain))
    if domain > 100:
        assert (got != shards.permuted(np.arange(domain), domain, 8)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(domain), got.astype(float))[0, 1]) < 0.2


def written(spark, docs, length, shard_rows):
    folder = work_path(spark, "shards")
    shards.write_shards(docs, folder, length, shard_rows)
    return folder, shards.with_slots(shards.read_shards(spark, folder, length), shards.shard_sizes(spark, folder, length))


def test_every_token_once(spark):
    texts = [None, "", "one two", "a " * 3000, "漢字 ends", "<|endoftext|>"] + [f"text {i} " * (i % 40) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, key string")
    docs = common.stored(docs.repartition(3), "docs")
    folder, records = written(spark, docs, 64, 20)
    rows = sorted(records.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert [(r.shard, r.key) for r in rows] == sorted((r.shard, r.key) for r in rows)
    codec = library.token_ids(library.RANKS, 2)
    count = sum(len(codec.encode(t or "")) // 2 + 1 for t in [*texts, "no id"])
    assert sum(r.n_tokens for r in rows) == count and len({r.shard for r in rows}) > 1
    whole = {}
    for i, t in [*enumerate(texts), (-(1 << 63), "no id")]:
        whole[i] = codec.encode(t or "") + b"\0\0"
    for r in rows:
        # A record begins inside the document it names, at the token it names.
        have = whole[r.doc_id][2 * r.start : 2 * r.start + 128]
        assert r.ids[: len(have)] == have[: len(r.ids)] and r.ids_crc32 == zlib.crc32(r.ids)
    # Fixed stride: any slot can be read by itself.
    size = shards.stride(64)
    for r in rows[::7]:
        (path,) = glob.glob(f"{folder}/shard={r.shard}/part-*".replace("file:", ""))
        with open(path, "rb") as file:
            file.seek(r.place * size)
            record = file.read(size)
        head = shards.unpack_from(shards.HEADER, record)
        assert head[4] == r.key and record[shards.calcsize(shards.HEADER) :][: 2 * r.n_tokens] == r.ids


def test_order_depends_on_the_key_alone(spark):
    docs = common.stored(spark.range(300).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 30) text"), "docs")
    first, again = (written(spark, docs, 32, 50)[1].select("slot", "ids_crc32", "doc_id").collect() for _ in range(2))
    assert sorted(first) == sorted(again)


def test_damage_is_seen(spark):
    docs = common.stored(spark.range(5).selectExpr("id doc_id", "repeat('word ', 50) text"), "docs")
    folder, _ = written(spark, docs, 16, 1000)
    path = glob.glob(f"{folder}/shard=*/part-*")[0]
    with open(path, "r+b") as file:
        file.seek(60)
        file.write(b"?")
    for crc in glob.glob(f"{folder}/shard=*/.part-*.crc"):
        open(crc, "wb").close()
    with pytest.raises(Exception):
        shards.read_shards(spark, folder, 16).collect()


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    codec = library.token_ids(library.RANKS, 2)
    count = sum(len(codec.encode(d.text or "")) // 2 + 1 for d in common.table(spark, sf_dir, "documents").collect())
    rows = shards.op9_training_order(spark, sf_dir).collect()
    assert sum(r.n_tokens for r in rows) == count and sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(r.n_tokens < shards.LENGTH for r in rows) <= 8


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    folder, records = written(spark, none, 64, 20)
    assert records.collect() == [] and shards.read_shards(spark, folder, 64).columns[0] == "shard"
    assert shards.shard_sizes(spark, folder, 64).collect() == []
