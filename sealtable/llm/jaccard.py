"""Operator 3: exact Jaccard join on word shingles by grouped prefixes.

A text's set holds the hashes of its distinct five-word shingles (A-Z lower-cased).  Sets
are read in one global order, rare shingles first; two sets of similarity 3/4 or more
then share a shingle among the first ``n - ceil(3n/4) + 1`` of each.  The order comes from
a count of all shingles in a sketch of fixed size: a bad estimate costs time, not links.

* Equal sets count once, as the smallest document id that has them (a node).
* Sets with the same prefix and size form a group, and only groups enter the posting
  lists.  A shingle whose estimate is high has its list dealt over several tasks.
* Each list has a hub, the group in which the shingle stands earliest relative to its
  size.  Pairs of a group and its hub that pass the size and position filters are
  expanded to their members and verified; so are the members of a group against its
  first one.  That is linear in the lists, and links nearly all that can be linked.
* Components follow from the verified links.  Lists whose members are in more than one
  component give the pairs across components that pass the filters; these are verified
  too.  Pairs within a component are never made, so no link is lost and no group of
  copies is written out in pairs.
* Before a pair is verified, a bit or two per shingle tell that most unlike pairs cannot be
  similar.  Only the texts of what is left are read into sets, and only those sets move.

Defined cases: a null or empty text, or one without words, has an empty set, links with
nothing and is its own component; a row without id has no component (null); repeated
rows are one node, and different texts under one id are linked.  Other columns are never
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealtable.llm import common

WORDS = 5
# Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 75
# The sketch: counters, and counters per stored block.
COUNTERS, BLOCK = 1 << 22, 1 << 16
# A list is dealt over as many tasks as its estimate holds this many entries, 4095 at most.
LIST_ROWS, MOST_PARTS = 1024, 4095
# A mark of a wanted text is one of 2^MARKS bits for its id and one of as many for its set.
MARKS = 25
# A posting's numbers in one: part (12 bits), position and size (26 bits each).  The part is
# also mixed into the key by this factor, so that a part is a list of its own.
BITS, FACTOR = 26, 0x1357_9BDF_2468


def _signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def _places(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """Stored rows ``(doc_id, n, sig)`` of each text and, with a null sig, the blocks of
    the sketch that each task counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig", "block", "counts"]
        counts = np.zeros(COUNTERS, np.int32)
        seen = False
        for batch in batches:
            sizes, sigs = [], []
            for _, s in common.shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                sigs.append(_signature(s))
                np.add.at(counts, _places(s), 1)
            seen = True
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sigs, pa.int64()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
        if seen:
            for k in range(0, COUNTERS, BLOCK):
                # One byte a counter: a task's own count ends at 255, which is frequent enough.
                part = np.minimum(counts[k : k + BLOCK], 255).astype(np.uint8)
                if part.any():
                    row = [None], [None], [None], [k // BLOCK], [part.tobytes()]
                    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names)

    schema = "doc_id long, n long, sig long, block int, counts binary"
    return common.stored(docs.mapInArrow(run, schema), "shingled")


def _summed(rows):
    """One block per group: the sum of its blocks."""
    import pandas as pd

    total = np.zeros(BLOCK, np.int64)
    for raw in rows["counts"]:
        total += np.frombuffer(raw, np.int64 if len(raw) == 8 * BLOCK else np.uint8)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [0], "counts": [total.tobytes()]})


def _levelled(rows):
    """One block per group: log2 of the sum of its blocks, one byte a counter."""
    import pandas as pd

    total = np.frombuffer(_summed(rows)["counts"].iloc[0], np.int64)
    levels = np.log2(np.maximum(total, 1)).astype(np.uint8)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [levels.tobytes()]})


def rarity(blocks: DataFrame, spread: int = 32) -> np.ndarray:
    """log2 of each counter, one byte each: what the order and the dealing need."""
    schema = "block int, part int, counts binary"
    dealt = blocks.select("block", F.pmod(F.xxhash64("counts"), F.lit(spread)).cast("int").alias("part"), "counts")
    once = dealt.groupBy("block", "part").applyInPandas(_summed, schema)
    out = np.zeros(COUNTERS, np.uint8)
    for row in once.groupBy("block").applyInPandas(_levelled, "block int, counts binary").collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return out


def _prefix(shingles: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix in the global order, and the rarity of its shingles."""
    n = len(shingles)
    level = rank[_places(shingles)]
    keep = n - -(-PERCENT * n // 100) + 1
    order = np.lexsort((shingles, level))[:keep]
    return shingles[order], level[order]


def _group(prefix: np.ndarray, n: int) -> int:
    return xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n) - (1 << 63)


def _odd(shingles: np.ndarray) -> bytes:
    """Which buckets hold an odd number of the shingles, a bit each.  There are as many as
    shingles, rounded up to a power of two, and 64 at least."""
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    held = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def _may_link(n: int, odd: bytes, n2: int, odd2: bytes) -> bool:
    """False only if the sets cannot be similar.  A bucket that is odd for one of them alone
    holds a shingle that the other lacks, and similar sets have 1/7 of both sizes of those at
    most.  The halves of a longer row of buckets add up to one half as long."""
    a, b = sorted((odd, odd2), key=len)
    one, other, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        other = (other >> bits) ^ (other & ((1 << bits) - 1))
    return (one ^ other).bit_count() * (100 + PERCENT) <= (n + n2) * (100 - PERCENT)


def grouped(docs: DataFrame, words: int, rank) -> DataFrame:
    """``(sig, g, n, odd)``: the group, size and odd buckets of each text that has a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(rank.value, np.uint8)
        for batch in batches:
            sigs, groups, sizes, odds = [], [], [], []
            for _, s in common.shingle_sets(batch.column(1), words):
                if len(s):
                    sigs.append(_signature(s))
                    groups.append(_group(_prefix(s, levels)[0], len(s)))
                    sizes.append(len(s))
                    odds.append(_odd(s))
            columns = [*(pa.array(c, pa.int64()) for c in (sigs, groups, sizes)), pa.array(odds, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "g", "n", "odd"])

    return docs.mapInArrow(run, "sig long, g long, n long, odd binary")


def postings(docs: DataFrame, words: int, rank) -> DataFrame:
    """``(key, g, place)``: the places of the groups' prefix shingles.  ``place`` holds the
    part of a dealt list (0 if it is not dealt), position and size: few columns make a
    small shuffle.  A task writes each group once, so copies are gone before anything is
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(rank.value, np.uint8)
        written: set[int] = set()
        names = ["key", "g", "place"]

        def flush(parts):
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            parts, held = [], 0
            for _, s in common.shingle_sets(batch.column(1), words):
                n = len(s)
                if not n:
                    continue
                prefix, level = _prefix(s, levels)
                g = _group(prefix, n)
                if g in written:
                    continue
                written.add(g)
                if n >> BITS:
                    raise ValueError("a text has more shingles than a posting can number")
                deals = np.minimum((1 << level.astype(np.int64)) // LIST_ROWS, MOST_PARTS)
                k = len(prefix)
                deal = np.where(deals > 1, 1 + g % np.maximum(deals, 1), 0)
                place = (deal << 2 * BITS) + (np.arange(k, dtype=np.int64) << BITS) + n
                parts.append((common.longs(prefix) ^ (deal * FACTOR), np.full(k, g), place))
                held += k
                if held > 200_000:
                    yield flush(parts)
                    parts, held = [], 0
            if parts:
                yield flush(parts)

    return docs.mapInArrow(run, "key long, g long, place long")


def _filters(n1, p1, n2, p2):
    """Size and position: what a pair with 3/4 in common must fulfil at its first shared
    shingle.  The overlap is at most what follows it, and it must be 3/7 of both sizes."""
    total = (n1 + n2) * PERCENT
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT) & (
        F.least(n1 - p1, n2 - p2) * (100 + PERCENT) >= total
    )


def lists(entries: DataFrame) -> DataFrame:
    """Entries of the lists that hold several groups, each with the hub of its list.  All
    parts of a dealt list stay, as the other groups may be in another part."""
    list_ = Window.partitionBy("key")
    order = list_.orderBy("relative", "g")
    low, deal = (1 << BITS) - 1, F.shiftrightunsigned("place", 2 * BITS)
    return (
        entries.repartition("key")
        .withColumns({"n": F.col("place").bitwiseAND(low), "pos": F.shiftright("place", BITS).bitwiseAND(low)})
        .withColumns({"token": F.col("key").bitwiseXOR(deal * FACTOR), "dealt": deal > 0})
        .withColumn("relative", _relative())
        .withColumn("hub", F.first(F.struct("g", "n", "pos")).over(order))
        .withColumn("before", F.lag("g").over(order))
        .withColumn("several", F.min("g").over(list_) < F.max("g").over(list_))
        .where("(before is null or before <> g) and (several or dealt)")
        .select("token", "dealt", "g", "n", "pos", "hub")
    )


def _relative():
    return F.floor(F.col("pos") * (1 << 20) / F.col("n"))


def hub_pairs(held: DataFrame) -> DataFrame:
    """``(g, hub_g)``: each group with the hub of its list, and the hubs of the parts of a
    dealt list with the first among them, where size and position allow a link."""
    parts = held.where("dealt and g = hub.g").withColumn("relative", _relative())
    first = F.first(F.struct("g", "n", "pos")).over(Window.partitionBy("token").orderBy("relative", "g"))
    near = held.select("g", "n", "pos", "hub").unionByName(
        parts.withColumn("hub", first).select("g", "n", "pos", "hub")
    )
    near = near.where(F.col("g") != F.col("hub.g")).where(
        _filters(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"))
    )
    return near.select("g", F.col("hub.g").alias("hub_g")).distinct()


def _alike(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of ``pairs (sig_a, a, sig_b, b)`` those that ``_may_link`` leaves."""
    for side in "ab":
        names = {name: f"{name}_{side}" for name in ("sig", "n", "odd")}
        pairs = pairs.join(members.select(*names).withColumnsRenamed(names), f"sig_{side}")
    names = ["sig_a", "a", "sig_b", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = (c.to_pylist() for c in batch.columns[len(names) :])
            keep = [_may_link(*end) for end in zip(*ends)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(keep, pa.bool_()))

    return pairs.select(*names, "n_a", "odd_a", "n_b", "odd_b").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _mark(values):
    """The mark of each value, of a column or an array of unsigned numbers."""
    if isinstance(values, np.ndarray):
        folded = values ^ (values >> np.uint64(MARKS)) ^ (values >> np.uint64(2 * MARKS))
        return (folded & np.uint64((1 << MARKS) - 1)).astype(np.int64)
    folded = values.bitwiseXOR(F.shiftrightunsigned(values, MARKS)).bitwiseXOR(F.shiftrightunsigned(values, 2 * MARKS))
    return folded.bitwiseAND((1 << MARKS) - 1)


def _marks(wanted: DataFrame) -> bytes:
    """The marks of ``wanted (doc_id, sig)``: bits of ids, then bits of sets.  Their size is
    fixed, so they reach every task however many texts are wanted; a mark that is set for
    another text costs time, not links."""
    both = F.array(_mark(F.col("doc_id")), _mark(F.col("sig")) + (1 << MARKS))
    places = wanted.select(F.explode(both).alias("place"))
    block = F.shiftright("place", 15).alias("block")
    bits = F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << 15) - 1)).alias("bits")
    out = bytearray(1 << MARKS >> 2)
    for row in places.groupBy(block).agg(bits).collect():
        out[row["block"] << 12 : (row["block"] + 1) << 12] = row["bits"]
    return bytes(out)


def _marked(marks: np.ndarray, values: np.ndarray, first: int) -> np.ndarray:
    place = _mark(values.astype(np.uint64)) + first
    return (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _verified(docs: DataFrame, pairs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """Of ``pairs (sig_a, a, sig_b, b)``, nodes a and b of those that are similar."""
    pairs = common.stored(_alike(pairs.distinct(), members), "candidates")
    wanted = pairs.select(F.col("a").alias("doc_id"), F.col("sig_a").alias("sig")).unionByName(
        pairs.select(F.col("b").alias("doc_id"), F.col("sig_b").alias("sig"))
    )
    held = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(held.value, np.uint8)
        written: set[int] = set()
        for whole in batches:
            whole = whole.filter(pa.array(_marked(marks, whole.column(0).to_numpy(), 0)))
            for at in range(0, whole.num_rows, 200):
                found = [s for _, s in common.shingle_sets(whole.column(1).slice(at, 200), words)]
                sigs = np.array([_signature(s) for s in found], np.int64)
                rows, sets = [], []
                for k in np.flatnonzero(_marked(marks, sigs, 1 << MARKS)).tolist():
                    # Repeated rows of an id would only repeat their pairs.
                    if len(found[k]) and int(sigs[k]) not in written:
                        written.add(int(sigs[k]))
                        rows.append(int(sigs[k]))
                        sets.append(common.longs(found[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), common.lists(sets, pa.int64())], ["sig", "shingles"]
                )

    sets = common.stored(docs.mapInArrow(run, "sig long, shingles array<long>"), "sets")
    held.destroy()
    # Sets move once, to the hubs; pairs come to them first.
    b = sets.withColumnsRenamed({"sig": "sig_b", "shingles": "set_b"}).join(common.small(pairs), "sig_b")
    hubs = common.small(pairs.select("sig_a").distinct())
    a = sets.withColumnsRenamed({"sig": "sig_a", "shingles": "set_a"}).join(hubs, "sig_a", "left_semi")
    both = b.select("sig_a", "a", "b", "set_b").join(a.hint("merge"), "sig_a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    found = common.stored(both.where(shared * 100 >= union * PERCENT).select("a", "b"), "links")
    common.discard(pairs, sets)
    return found


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row."""
    with common.shuffles_deleted(docs.sparkSession):
        return _similar_components(docs, id_col, text_col, words)


def _similar_components(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = shingled(docs, words)
    rows = first.where("block is null").select("doc_id", "n", "sig")
    ids = docs.where("doc_id is not null")
    rank = spark.sparkContext.broadcast(rarity(first.where("block is not null")).tobytes())

    # Nodes: the smallest id of each distinct set; members: which group a node is in.
    sets = rows.where("n > 0 and doc_id is not null")
    nodes = common.stored(sets.groupBy("sig").agg(F.min("doc_id").alias("node")), "nodes")
    groups = grouped(ids, words, rank).groupBy("sig").agg(*(F.min(c).alias(c) for c in ("g", "n", "odd")))
    members = common.stored(groups.join(nodes, "sig"), "members")
    chiefs = members.groupBy("g").agg(
        F.min(F.struct("node", "sig")).alias("chief"), F.count("*").alias("size")
    )
    chiefs = common.stored(chiefs.select("g", "size", "chief.node", "chief.sig"), "chiefs")

    held = common.stored(lists(postings(ids, words, rank)), "lists")

    hubs = chiefs.select(F.col("g").alias("hub_g"), F.col("sig").alias("sig_a"), F.col("node").alias("a"))
    mine = members.select("g", F.col("sig").alias("sig_b"), F.col("node").alias("b"))
    stars = hub_pairs(held).join(mine, "g").join(hubs, "hub_g")
    inside = mine.join(hubs.withColumnRenamed("hub_g", "g"), "g").where("a <> b")
    names = ["sig_a", "a", "sig_b", "b"]
    links = _verified(ids, stars.select(*names).unionByName(inside.select(*names)), members, words)

    # Different texts under one id are one document.
    several = sets.groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi")
    own = sets.join(common.small(several.select("doc_id")), "doc_id").join(nodes, "sig").select("doc_id", "node")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    same = own.withColumnRenamed("node", "a").join(least, "doc_id").where("a <> b").select("a", "b")
    found = common.stored(common.components(links.unionByName(same)), "found").withColumnRenamed("id", "node")

    # What is left: pairs across components in one list, or in one group.
    placed = members.join(found, "node", "left").select(
        "g", "node", F.coalesce("component", "node").alias("component")
    )
    listed = held.select("token", "g", "n", "pos").unionByName(
        chiefs.where("size > 1").select(F.col("g").alias("token"), "g", F.lit(1).alias("n"), F.lit(0).alias("pos"))
    )
    list_ = Window.partitionBy("token")
    mixed = F.min("component").over(list_) < F.max("component").over(list_)
    open_ = listed.join(placed, "g").select("token", "node", "n", "pos", "component", mixed.alias("mixed")).where("mixed")
    x = open_.select("token", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "component")))
    y = open_.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "component")))
    across = x.join(y, "token").where(
        (F.col("component_a") < F.col("component_b"))
        & _filters(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
    )
    across = common.stored(across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "across")
    mine = members.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    theirs = members.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    late = _verified(ids, across.join(mine, "a").join(theirs, "b").select(*names), members, words)
    common.discard(held, across)
    # The components that late links join; found ones are not gone through again.
    ends = late.select(F.col("a").alias("node")).unionByName(late.select(F.col("b").alias("node"))).distinct()
    of = common.small(common.stored(found.join(common.small(ends), "node"), "ends"))
    for side in ("a", "b"):
        named = of.select(F.col("node").alias(side), F.col("component").alias("c"))
        late = late.join(named, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    joined = common.components(late).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    joined = common.small(common.stored(joined, "joined"))
    common.discard(members, chiefs)
    return (
        rows.join(nodes, "sig", "left")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node", "doc_id"))
        .join(joined, "component", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("whole", "component")).alias("component_id"),
        )
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every whole text and the smallest id that its links reach."""
    return similar_components(common.table(spark, sf_dir, "documents"))


# The same links and components in DuckDB: shingles as text, all pairs that share one.
ORACLE = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
    FROM words WHERE w IS NOT NULL
), sizes AS (
    SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY 1
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * hits >= 75 * (x.n + y.n - hits)
), reach AS (
    SELECT doc_id AS id, doc_id AS other FROM documents
    UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, z.n AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN sizes z USING (doc_id) JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id, z.n
"""
