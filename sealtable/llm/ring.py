"""Operator 11: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` places on a ring of 64-bit hashes, every row one place, hashed
from its id.  A row goes to the shard of the next place clockwise; if that shard is full,
it continues clockwise to the next shard that is not.  A shard is full once its bytes
reach ``capacity``, the mean plus ``slack``.

Rows arrive largest first, so a shard is filled up by its smallest rows and overshoots by
one arrival of these.  The arrivals that come one at a time in other forms of the method
are found here by a few aggregations: in each round every row takes the first shard
clockwise that is still open at the row's turn, and each shard's turn of closing is where
its running sum reaches the capacity.  Closing turns only move forward, at least one is
final after each round, and the rounds end when none moves: that is the state which
arrivals one by one would lead to.  A round brings one number per shard to the driver.

Rows above ``capacity / LARGE`` bytes, fewer than ``shards * LARGE`` whatever the table,
are placed before the others, each in the first shard clockwise with room for it, or else
in the least filled one.  A turn is the size (by classes of 1/32 of a power of two) and
sixteen bits of a hash; rows of one turn arrive together.

Only DataFrame functions are used.  The texts are read once; all later steps work on
narrow rows, none of which depends on the size of a group.

Defined cases: a null text has no bytes (size 1, checksum 0), an empty one neither; rows
that repeat an id, and rows without id, are keys of their own, told apart by a number
in the order of their texts' hashes (equal rows are interchangeable); an empty table gives
no rows; other columns are never read; ties of place go to the smaller shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealtable.llm import common

SHARDS, NODES, SLACK, LARGE = 8, 512, 0.0, 64
# The ring is a table that every executor gets: so many places at most, each with an order
# of all shards.
MOST_PLACES, MOST_ORDERS = 1 << 14, 1 << 22
SLOT_BITS = 12
_NEVER, _ALWAYS = -1, (1 << 62)


def _slot(place: Column) -> Column:
    """The part of the ring that a place lies in, ascending with the signed place."""
    return (F.shiftright(place, 64 - SLOT_BITS) + (1 << (SLOT_BITS - 1))).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """``(slot, own, beyond)``: the places in each part of the ring with the order in which
    a row that lands before them visits the shards, and the order behind the last one."""
    if shards < 1 or nodes < 1 or shards * nodes > MOST_PLACES or shards * shards * nodes > MOST_ORDERS:
        raise ValueError(f"a ring has at most {MOST_PLACES} places and {MOST_ORDERS} entries in their orders")
    places = spark.range(0, shards * nodes, 1, 1).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"),
    )
    whole = places.agg(F.sort_array(F.collect_list(F.struct("at", "shard"))).alias("all"))
    round_twice = F.concat(F.col("all.shard"), F.col("all.shard"))
    each = whole.select(round_twice.alias("shards"), F.posexplode("all").alias("i", "node"))
    orders = each.select(
        "i", "node.at", F.array_distinct(F.slice("shards", F.col("i") + 1, shards * nodes)).alias("order")
    )
    own = orders.groupBy(_slot(F.col("at")).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("at", "order"))).alias("own"))
    slots = spark.range(0, 1 << SLOT_BITS, 1, 1).select(F.col("id").cast("int").alias("slot")).join(own, "slot", "left")
    behind = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    start = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("own")[0]["order"]
    return slots.select(
        "slot",
        F.coalesce("own", F.array().cast("array<struct<at:bigint,order:array<int>>>")).alias("own"),
        F.coalesce(F.first(first, True).over(behind), F.first(first, True).over(start)).alias("beyond"),
    )


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``copy``, 0 for an id that stands once; groups of one id may have any size."""
    rows = rows.withColumn("key", F.struct("doc_id"))
    twice = common.stored(rows.groupBy("key").count().where("count > 1").select("key"), "repeated")
    if twice.isEmpty():
        return rows.drop("key").withColumn("copy", F.lit(0).cast("long"))
    again = rows.join(common.small(twice), "key", "left_semi")
    again = common.placed(again.drop("key"), ["doc_id"], ["hash", "size"], "copies", "copy")
    return rows.join(common.small(twice), "key", "left_anti").drop("key").withColumn("copy", F.lit(0).cast("long")).unionByName(again)


def _turn(size: Column, key: Column) -> tuple[Column, Column]:
    """Size class, larger sizes first, and the turn within it."""
    exponent = F.length(F.bin(size)) - 1
    step = F.call_function("shiftright", F.shiftleft(size, 5), exponent).cast("int") - 32
    return (F.lit(2048) - (exponent * 32 + step)).cast("long"), F.pmod(F.xxhash64(F.lit("turn"), key), F.lit(1 << 16))


def keyed(rows: DataFrame, shards: int, nodes: int) -> DataFrame:
    """Rows with their place on the ring, their turn, and the order of shards clockwise."""
    at = F.xxhash64(F.lit("key"), F.col("doc_id"), F.col("copy"))
    rows = rows.withColumn("at", at).withColumn("slot", _slot(F.col("at")))
    found = rows.join(F.broadcast(ring(rows.sparkSession, shards, nodes)), "slot")
    ahead = F.filter("own", lambda node: node["at"] >= F.col("at"))
    kind, turn = _turn(F.col("size"), F.col("at"))
    return found.select(
        "doc_id", "size", "text_crc32", "at",
        kind.alias("kind"), (kind * (1 << 16) + turn).alias("turn"),
        F.coalesce(F.get(ahead, F.lit(0))["order"], F.col("beyond")).alias("order"),
    )


def _large(keys: DataFrame, capacity: int, shards: int) -> DataFrame:
    """The large rows with their shards: one row's array, folded in order of arrival."""
    entry = F.struct((-F.col("size")).alias("less"), "at", "doc_id", "text_crc32", "size", "order")
    whole = keys.agg(F.sort_array(F.collect_list(entry)).alias("rows"))

    def chosen(loads: Column, row: Column) -> Column:
        room = F.filter(row["order"], lambda s: F.get(loads, s) + row["size"] <= capacity)
        least = F.array_position(loads, F.array_min(loads)).cast("int") - 1
        return F.coalesce(F.get(room, F.lit(0)), least)

    def put(state: Column, row: Column) -> Column:
        def taken(shard: Column) -> Column:
            added = lambda load, s: load + F.when(s == shard, row["size"]).otherwise(F.lit(0))
            return F.struct(
                F.transform(state["loads"], added).alias("loads"),
                F.concat(state["shards"], F.array(shard)).alias("shards"),
            )

        # The choice is evaluated once: a lambda variable holds it.
        return F.transform(F.array(chosen(state["loads"], row)), taken)[0]

    none = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("shards")
    )
    folded = whole.select("rows", F.aggregate("rows", none, put)["shards"].alias("shards"))
    placed = folded.select(F.explode(F.arrays_zip("rows", "shards")).alias("x"))
    return placed.select(*[F.col("x.rows")[c].alias(c) for c in ("doc_id", "size", "text_crc32", "at")], F.col("x.shards").alias("shard"))


def _open_at(order: Column, turn: Column, closing: list[int]) -> Column:
    """The first shard clockwise that is still open at a row's turn."""
    turns = F.array(*[F.lit(c).cast("long") for c in closing])
    return F.get(F.filter(order, lambda s: F.get(turns, s) >= turn), F.lit(0))


def _crossing(sums: DataFrame, by: str, loads: list[int], capacity: int) -> DataFrame:
    """Per shard the first ``by`` whose running sum reaches the capacity and is not the last
    of all, with the sum before it."""
    base = F.get(F.array(*[F.lit(x).cast("long") for x in loads]), F.col("shard"))
    order = Window.partitionBy("shard").orderBy(by)
    running = sums.withColumn("before", base + F.sum("bytes").over(order) - F.col("bytes"))
    full = running.where(F.col("before") + F.col("bytes") >= capacity)
    return full.groupBy("shard").agg(F.min_by(F.struct(by, "before"), by).alias("x")).select("shard", f"x.{by}", "x.before")


def closing_turns(keys: DataFrame, loads: list[int], capacity: int) -> list[int]:
    """The turn after which each shard takes no more rows."""
    closing = [_NEVER if load >= capacity else _ALWAYS for load in loads]
    while True:
        placed = keys.select("size", "kind", "turn", _open_at(F.col("order"), F.col("turn"), closing).alias("shard"))
        sums = placed.groupBy("shard", "kind").agg(F.sum("size").alias("bytes"))
        kinds = {r.shard: r for r in _crossing(sums, "kind", loads, capacity).collect()}
        if not kinds:
            return closing
        at = F.get(F.array(*[F.lit(kinds[s].kind if s in kinds else -1).cast("long") for s in range(len(loads))]), F.col("shard"))
        inside = placed.where(F.col("kind") == at).groupBy("shard", "turn").agg(F.sum("size").alias("bytes"))
        base = [kinds[s].before if s in kinds else 0 for s in range(len(loads))]
        now = list(closing)
        for row in _crossing(inside, "turn", base, capacity).collect():
            now[row.shard] = min(now[row.shard], row.turn)
        if now == closing:
            return closing
        closing = now


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    nodes: int = NODES,
    slack: float = SLACK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, size, text_crc32, at, shard)`` for every row; sizes of shards are near equal."""
    rows = common.stored(_sizes(docs, id_col, text_col), "sizes")
    keys = common.stored(keyed(_numbered(rows), shards, nodes), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    capacity = -(-int(total * (1 + slack)) // shards)
    bound = capacity // LARGE
    large = common.stored(_large(keys.where(F.col("size") > bound), capacity, shards), "large")
    filled = {r.shard: r.bytes for r in large.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    rest = keys.where(F.col("size") <= bound)
    closing = closing_turns(rest, [filled.get(s, 0) for s in range(shards)], capacity)
    put = rest.select("doc_id", "size", "text_crc32", "at", _open_at(F.col("order"), F.col("turn"), closing).alias("shard"))
    return put.unionByName(large.select(*put.columns))


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of near equal bytes, each with its place in the shard."""
    rows = shard_rows(common.table(spark, sf_dir, "documents"))
    placed = common.placed(rows, ["shard"], ["at", "doc_id"], "slots", "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
