"""Operator 12: a Merkle manifest of a dataset, with checkpoints and recomputed proofs.

Rows are leaves, in order of id within their group; two nodes in a row become their digest
until one is left, a last node without partner is hashed alone.  Only every ``step``-th
level is written: level 0, ``step``, ``2 * step`` and so on.  Whatever lies between two
written levels falls into aligned subtrees of at most ``2 ** step`` written nodes, each of
which a task holds by itself.  Proofs go from the top down: the interior of a subtree is
computed again from its written nodes, each of these gets the siblings on its way up,
followed by those of the subtree's own top, and the interior is dropped.

The tops of all groups, in order of the group, are the leaves of a last tree, whose top is
the root.  Groups may have any size: leaves are placed by ranges of group and id.  Digests
travel as 32 bytes; what is hashed is their lowercase hex text.

A row's digest is that of its columns' UTF-8 texts in a given order, each with its length,
so that equal digests mean equal rows.  ``folded`` computes a root from a digest and its
siblings in plain Spark SQL, which is how any holder of a row can check it.

Defined cases: null columns count as ``-`` and are not empty texts; rows without id come
first in their group; rows that repeat an id are ordered by digest, equal rows are leaves
of their own; a null group is a group, the first one; a group of one row is its own top; an
empty table has no rows and no root; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common

STEP = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# One entry for each level on the way up: a digest, or null where a node is hashed alone.
SIBLINGS = "array<struct<left:boolean,digest:binary>>"


def row_digest(columns: dict[str, Column]) -> Column:
    """Lowercase hex digest of the columns' texts with their lengths."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns.values()]), 256)


def _hash(*digests: bytes) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def _levels(nodes: list[bytes], count: int) -> list[list[bytes]]:
    """The nodes and ``count`` levels above them."""
    out = [nodes]
    for _ in range(count):
        below = out[-1]
        out.append([_hash(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return out


def _height(size: int, step: int) -> int:
    """Levels from the ``size`` nodes of a group to the next written level, or to its top."""
    return min(step, max(0, size - 1).bit_length())


def _subtrees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[dict[str, list]]:
    """Runs of rows with equal ``tree`` and ``part``, as lists by column; a run has ``width``
    rows and one more at most, since the rows are sorted by them."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, part = batch.column("tree").to_numpy(), batch.column("part").to_numpy()
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist()):
            rows = {n: batch.column(n).slice(a, b - a).to_pylist() for n in batch.schema.names}
            if held and (held["tree"][0], held["part"][0]) == (rows["tree"][0], rows["part"][0]):
                held = {n: held[n] + rows[n] for n in held}
            else:
                if held:
                    yield held
                held = rows
            if len(held["tree"]) > width + 1:
                raise ValueError("places in a group are not those from 0 on")
    if held:
        yield held


def _by_subtree(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "part").sortWithinPartitions("tree", "part", "place")


def written_levels(leaves: DataFrame, step: int = STEP) -> list[DataFrame]:
    """Every ``step``-th level over ``leaves (tree, place, size, digest)``, the last holding
    the tops; ``size`` is the number of the tree's nodes on that level.  A tree that is
    complete stands in no further level but the last."""
    width, levels = 1 << step, [leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _subtrees(batches, width):
            size = rows["size"][0]
            top = _levels(rows["digest"], _height(size, step))[-1]
            numbers = [rows["tree"][0], rows["part"][0], -(-size // width)]
            columns = [*[pa.array([n], pa.int64()) for n in numbers], pa.array(top, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "size", "digest"])

    largest = leaves.agg(F.max("size")).first()[0] or 0
    done: DataFrame | None = None
    while True:
        rows = levels[-1].select("tree", F.floor(F.col("place") / width).alias("part"), "place", "size", "digest")
        above = common.stored(_by_subtree(rows).mapInArrow(run, "tree long, place long, size long, digest binary"), "level")
        tops = above.where("size = 1")
        done = tops if done is None else done.unionByName(tops)
        largest = -(-largest // width)
        if largest <= 1:
            return [*levels, done]
        levels.append(common.stored(above.where("size > 1"), "level"))


def _ways(nodes: list[bytes], height: int, above: list) -> Iterator[list]:
    """Each node's siblings up to ``height``, then those above; the interior is dropped."""
    levels = _levels(nodes, height)[:-1]
    for k in range(len(nodes)):
        way = []
        for level in levels:
            other = k ^ 1
            way.append({"left": other < k, "digest": level[other] if other < len(level) else None})
            k >>= 1
        yield way + above


def siblings(levels: list[DataFrame], tops: DataFrame, step: int = STEP) -> DataFrame:
    """Every leaf, with all columns of the lowest level, and its ``siblings``.  ``tops (tree,
    siblings)`` has what follows above the top of each tree, null for nothing."""
    width = 1 << step
    way_kind = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def noted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                kinds.update((n, batch.schema.field(n).type) for n in batch.schema.names)
                yield batch

        for rows in _subtrees(noted(batches), width):
            # The subtree's own row, without digest, stands before its nodes.
            (first, *nodes), size, after = rows["digest"], rows["size"], rows.pop("siblings")[0] or []
            if first is not None or None in nodes or not nodes:
                raise ValueError(f"subtree {rows['part'][0]} of tree {rows['tree'][0]} has no single row above it")
            ways = list(_ways(nodes, _height(size[1], step), after))
            names = [n for n in rows if n != "part"]
            for a in range(0, len(nodes), 256):
                columns = [pa.array(rows[n][1 + a : 257 + a], kinds[n]) for n in names]
                columns.append(pa.array(ways[a : a + 256], way_kind))
                yield pa.RecordBatch.from_arrays(columns, [*names, "siblings"])

    # What stands above a top: the row of the only subtree of its tree's last level.
    carried = tops.select("tree", F.lit(0).cast("long").alias("place"), "siblings")
    pending: DataFrame | None = None
    for number in range(len(levels) - 2, -1, -1):
        nodes = levels[number]
        # Trees whose last level this is take their row from the tops, others from the level above.
        ends = nodes.where("place = 0").where(F.col("size") <= width).select("tree")
        above = carried.join(ends, "tree", "left_semi")
        above = above if pending is None else above.unionByName(pending.select("tree", "place", "siblings"))
        rows = nodes.withColumn("part", F.floor(F.col("place") / width)).withColumn("siblings", F.lit(None).cast(SIBLINGS))
        kept = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema if f.name not in ("tree", "place")]
        heads = above.select("tree", F.col("place").alias("part"), F.lit(-1).cast("long").alias("place"), "siblings", *kept)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
        found = _by_subtree(rows.unionByName(heads)).mapInArrow(run, f"{schema}, siblings {SIBLINGS}")
        pending = found if number == 0 else common.stored(found, "ways")
    return pending


def folded(digest: Column, way: Column) -> Column:
    """The root that a digest (hex) leads to with its siblings."""

    def up(node: Column, at: Column) -> Column:
        other = F.lower(F.hex(at["digest"]))
        pair = F.when(at["digest"].isNull(), node).when(at["left"], F.concat(other, node)).otherwise(F.concat(node, other))
        return F.sha2(pair, 256)

    return F.aggregate(way, digest, up)


def proof_digest(way: Column) -> Column:
    """Digest of all siblings, from the leaf's level up."""
    there = F.filter(way, lambda at: at["digest"].isNotNull())
    return F.sha2(F.array_join(F.transform(there, lambda at: F.lower(F.hex(at["digest"]))), ""), 256)


def manifest(leaves: DataFrame, step: int = STEP) -> DataFrame:
    """``leaves (grp, id, digest, ...)``, ``digest`` being 32 bytes, with ``subroot``, ``root``
    (32 bytes) and ``siblings``."""
    extra = [c for c in leaves.columns if c not in ("grp", "id", "digest")]
    placed = common.stored(common.placed(leaves, ["grp"], ["id", "digest"], "placed", "place"), "leaves")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("size"))
    # Trees are numbered in order of their group, null first; strings compare bytewise.
    trees = common.stored(common.placed(sizes, [], ["grp"], "groups", "tree"), "trees")
    key = F.struct("grp").alias("key")
    found = placed.withColumn("key", key).join(common.small(trees.select(key, "tree", "size")), "key")
    numbered = found.select("tree", "place", "size", "digest", "id", *extra)
    levels = written_levels(numbered.select("tree", "place", "size", "digest"), step)
    levels[0] = numbered
    tops = levels[-1].select("tree", F.col("digest").alias("subroot"))

    crown = tops.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
        F.lit(trees.count()).cast("long").alias("size"), F.col("subroot").alias("digest"),
    )
    crown_levels = written_levels(crown, step)
    nothing = crown_levels[-1].select("tree", F.lit(None).cast(SIBLINGS).alias("siblings"))
    crown_ways = common.stored(siblings(crown_levels, nothing, step), "crown").select(F.col("place").alias("tree"), "siblings")
    whole = crown_levels[-1].select(F.col("digest").alias("root"))
    named = common.small(tops.join(common.small(trees), "tree").select("tree", "grp", "subroot"))
    found = siblings(levels, crown_ways, step).join(named, "tree")
    return found.select("grp", "id", "digest", *extra, "subroot", whole.scalar().alias("root"), "siblings")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its digest and proof, and the root that a tampered copy leads to."""
    docs = common.table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = row_digest({**columns, "n_chars": F.col("n_chars") + 1})
    leaves = docs.select(
        F.col("lang").alias("grp"),
        F.col("doc_id").cast("long").alias("id"),
        F.unhex(row_digest(columns)).alias("digest"),
        F.unhex(F.when(tampered & F.col("n_chars").isNotNull(), other)).alias("tampered"),
    )
    found = manifest(leaves)
    shown = F.lower(F.hex("digest"))
    folds = found.select(
        F.col("id").alias("doc_id"),
        shown.alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lower(F.hex("root")).alias("root"),
        proof_digest(F.col("siblings")).alias("proof_sha256"),
        folded(F.coalesce(F.lower(F.hex("tampered")), shown), F.col("siblings")).alias("folded_root"),
    )
    return folds.withColumn("verified", F.col("folded_root") == F.col("root"))


# Remainders of the CRC polynomial, from its rule: eight shifts for each byte.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"""


def _part(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _digest_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_part(n_chars if c == 'n_chars' else c) for c in COLUMNS)})"


ORACLE = f"""
with recursive base as (
    select doc_id, lang, {_digest_sql("n_chars")} as leaf,
           case when xor({_CRC}, 4294967295) % 7 = 0 then {_digest_sql("n_chars + 1")} else {_digest_sql("n_chars")} end as seen
    from documents),
placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place,
           dense_rank() over (order by lang nulls first) - 1 as tree from base),
up(tree, level, place, digest, nodes) as (
    select tree, 0, place, leaf, count(*) over (partition by tree) from placed
    union all
    select tree, level + 1, place // 2, sha256(string_agg(digest, '' order by place)), (any_value(nodes) + 1) // 2
    from up where nodes > 1 group by tree, level, place // 2),
subroots as (select tree, digest, level from up where nodes = 1),
crown(level, place, digest, nodes) as (
    select 0, tree, digest, count(*) over () from subroots
    union all
    select level + 1, place // 2, sha256(string_agg(digest, '' order by place)), (any_value(nodes) + 1) // 2
    from crown where nodes > 1 group by level, place // 2),
root as (select digest, level from crown where nodes = 1),
steps as (
    select p.tree, p.place as leaf_place, n.level as step, p.place >> n.level as at, s.digest as other
    from placed p join subroots r using (tree)
    join (select distinct tree, level from up) n on n.tree = p.tree and n.level < r.level
    left join up s on s.tree = p.tree and s.level = n.level and s.place = xor(p.place >> n.level, 1)
    union all
    select p.tree, p.place, r.level + n.level, p.tree >> n.level, s.digest
    from placed p join subroots r using (tree), root o
    join (select distinct level from crown) n on n.level < o.level
    left join crown s on s.level = n.level and s.place = xor(p.tree >> n.level, 1)),
proofs as (
    select tree, leaf_place, sha256(coalesce(string_agg(other, '' order by step) filter (other is not null), '')) as proof_sha256
    from steps group by tree, leaf_place),
fold(tree, leaf_place, step, digest) as (
    select tree, place, 0, seen from placed
    union all
    select f.tree, f.leaf_place, f.step + 1,
           sha256(case when s.other is null then f.digest when s.at % 2 = 1 then s.other || f.digest else f.digest || s.other end)
    from fold f join steps s on s.tree = f.tree and s.leaf_place = f.leaf_place and s.step = f.step),
ends as (select tree, leaf_place, arg_max(digest, step) as folded_root from fold group by tree, leaf_place)
select p.doc_id, p.leaf, r.digest as subroot, o.digest as root,
       coalesce(q.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = o.digest as verified
from placed p join subroots r using (tree) cross join root o
left join proofs q on q.tree = p.tree and q.leaf_place = p.place
join ends e on e.tree = p.tree and e.leaf_place = p.place"""
