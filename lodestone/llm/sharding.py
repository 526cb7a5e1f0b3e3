"""Sharding (4): best-fit-decreasing packing of indivisible groups into shards.

Groups (equal texts) go from the largest to the smallest into the open bin with the least room that still
fits, found in a balanced tree of rooms. Either the number of shards is given, and their bytes come out near equal, or
the capacity is, and as few shards as that takes are opened. Groups of the same size are alike to the packer, so
it works on the histogram of sizes, `(size, count)` pairs of exact sizes, and hands each size a quota per shard; the driver holds
one entry per different size. Which group of a size gets which place is settled by its rank among them, found without gathering a size in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Chunks, materialize

OVERHEAD = 16
LANES = 256
#: Ranks of a size whose places are looked up together.
SEGMENT = 4096
#: Groups with more than 1/HOT of the rows, so HOT of them at most, are joined by broadcast.
HOT = 1000


def doc_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def even_capacity(classes: list[tuple[int, int]], shards: int) -> int:
    """The bytes a shard gets when each group above that has a shard of its own and the rest is spread evenly."""
    left, bins = sum(size * n for size, n in classes), shards
    for size, n in sorted(classes, reverse=True):
        for _ in range(n):
            if bins <= 1 or size * bins <= left:
                return -(-left // max(1, bins))
            left, bins = left - size, bins - 1
    return -(-left // max(1, bins))


class RoomTree:
    """Open bins as (room, shard) in a treap: a search tree that priorities, a mix of the shard's number, keep balanced."""

    def __init__(self):
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _merge(a: list | None, b: list | None) -> list | None:
        """One tree of two, all of whose keys lie in this order."""
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = RoomTree._merge(a[3], b)
            return a
        b[2] = RoomTree._merge(a, b[2])
        return b

    @staticmethod
    def _split(node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """The keys below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = RoomTree._split(node[3], key)
            return node, rest
        rest, node[2] = RoomTree._split(node[2], key)
        return rest, node

    def add(self, room: int, shard: int) -> None:
        key = (room, shard)
        low, high = self._split(self.root, key)
        priority = (shard * 0x9E3779B97F4A7C15 ^ room * 0xBF58476D1CE4E5B9) * 0x94D049BB133111EB >> 7 & 0xFFFFFFFFFFFF
        self.root = self._merge(self._merge(low, [key, priority, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and gives the bin with the least room that holds `size`."""
        low, high = self._split(self.root, (size, -1))
        best, up = high, None
        while best is not None and best[2] is not None:
            best, up = best[2], best
        if best is None:
            self.root = low
            return None
        if up is None:
            high = best[3]
        else:
            up[2] = best[3]
        self.root = self._merge(low, high)
        return best[0]

    def take_roomiest(self) -> tuple[int, int]:
        best, up = self.root, None
        while best[3] is not None:
            best, up = best[3], best
        if up is None:
            self.root = best[2]
        else:
            up[3] = best[2]
        return best[0]


def pack(classes: list[tuple[int, int]], capacity: int, shards: int | None = None) -> dict[int, list[tuple[int, int]]]:
    """Best-fit decreasing over a histogram (size, count): for each size, the (shard, count) runs it is placed in.

    The tightest bin that fits takes as many groups of a size as it holds, for it stays the tightest. Where none fits a new shard is opened, and
    a group above the capacity has one of its own; with `shards` given, all are open from the start and what fits nowhere goes to the one with most room.
    """
    rooms, opened = RoomTree(), shards or 0
    for s in range(opened):
        rooms.add(capacity, s)
    out: dict[int, list[tuple[int, int]]] = {}
    for size, n in sorted(classes, reverse=True):
        runs = out.setdefault(size, [])
        while n:
            found = rooms.take_tightest(size)
            if found is None and shards:
                found = rooms.take_roomiest()
            elif found is None:
                found, opened = (capacity, opened), opened + 1
            room, shard = found
            fits = min(n, max(1, room // size)) if size else n
            runs.append((shard, fits))
            rooms.add(room - fits * size, shard)
            n -= fits
    return out


def shard_groups(docs: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """(key, members, shard) of every group of rows (key, size) with one key."""
    spark = docs.sparkSession
    groups = docs.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("members"))
    groups = materialize(groups.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(LANES)).cast("int")), "groups")
    lanes = materialize(groups.groupBy("bytes", "lane").agg(F.count("*").alias("n")), "lanes")
    classes = [(r["bytes"], r["n"]) for r in lanes.groupBy("bytes").agg(F.sum("n").alias("n")).collect()]  # one row per different size
    quota = []
    for size, runs in pack(classes, capacity if shards is None else even_capacity(classes, shards), shards).items():
        begin = 0
        for shard, n in runs:
            quota.append((size, begin, begin + n, shard))
            begin += n
    packed = spark.createDataFrame(quota, "bytes long, begin long, end long, shard int")
    each = packed.withColumn("segment", F.explode(F.sequence(F.floor(F.col("begin") / SEGMENT), F.floor((F.col("end") - 1) / SEGMENT))))
    by_segment = each.groupBy("bytes", "segment").agg(F.collect_list(F.struct("begin", "end", "shard")).alias("runs"))  # a run has a rank at least: SEGMENT of them at most
    base = lanes.selectExpr("bytes AS b", "lane AS l", "sum(n) OVER (PARTITION BY bytes ORDER BY lane) - n AS base")
    ranked = groups.withColumn("rel", F.row_number().over(Window.partitionBy("bytes", "lane").orderBy("key")) - 1)
    ranked = ranked.join(base, (F.col("bytes") == F.col("b")) & (F.col("lane") == F.col("l"))).select("key", "members", "bytes", (F.col("base") + F.col("rel")).alias("rank"))
    ranked = ranked.withColumn("segment", F.floor(F.col("rank") / SEGMENT)).join(by_segment, ["bytes", "segment"])
    own = F.get(F.filter("runs", lambda r: (r["begin"] <= F.col("rank")) & (F.col("rank") < r["end"])), F.lit(0))
    return materialize(ranked.select("key", "members", own["shard"].alias("shard")), "group_shards")


def group_key(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def shard(docs: DataFrame, shards: int | None = 40, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row; law is `bytes`: sizes near equal.

    size: UTF-8 bytes of the text (null: none, a group of its own) plus 16. Equal texts share a shard; a group larger than the mean has its
    shard above the mean, as groups are indivisible. With `shards` None, shards hold `capacity` bytes (a larger group has one of its own), and as few
    as best fit decreasing takes are opened. slot counts a shard's rows in the order of (id, a hash of the text), null ids first,
    from 0 without gaps; equal rows are interchangeable. An empty table gives no rows. Further columns aren't read.
    """
    if shards is None and not capacity:
        raise ValueError("give the number of shards or their capacity")
    chunks = Chunks(docs.select(id_col), id_col, 20_000)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("row_id"), group_key(text).alias("key"), doc_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    rows = materialize(rows.withColumn("chunk", chunks.of(F.col("row_id"), F.col("tie"))), "rows")
    groups = shard_groups(rows.select("key", "size"), shards, capacity)
    total = rows.count()
    hot = groups.where(F.col("members") * HOT > total).select("key", F.col("shard").alias("hot_shard"))
    rows = rows.join(F.broadcast(hot), "key", "left")
    found = F.when(F.col("hot_shard").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.floor(F.rand(7) * 100_000).cast("string")))  # no group's key: these rows are spread, and joined already
    rows = rows.withColumn("found", found).join(groups.select(F.col("key").alias("found"), "shard"), "found", "left").withColumn("shard", F.coalesce("hot_shard", "shard"))
    placed = materialize(rows.select("row_id", "size", "text_crc32", "tie", "chunk", "shard"), "placed")
    base = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).selectExpr("shard AS s", "chunk AS c", "sum(n) OVER (PARTITION BY shard ORDER BY chunk) - n AS base")
    slots = placed.withColumn("rel", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row_id", "tie")) - 1)
    return slots.join(base, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c"))).select(
        F.col("row_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rel")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
