"""Mixing sources to target weights (5): Sainte-Lague apportionment of equal-token blocks.

Each source's text is one stream of words in doc_id order, cut into blocks of equal size. Blocks of the mix
go to the sources by highest quotients target / (2 q + 1), and each source's quota is split over output shards by the same
rule, so every quota is an integer. Within a shard a seeded permutation picks the blocks; a quota above the
source's own blocks repeats the whole source first. All of it is arithmetic on positions: no block is a row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Chunks, materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 8
SHARDS = 16
#: Rows of a chunk: sums of words run within one, and over the chunks of a source.
CHUNK = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of the total by weight, none above `most` times its size; the excess is shared again by weight among the rest."""
    total, out, free = sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free -= over
    return out


def sainte_lague(shares: list[Fraction], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients share / (2 q + 1), ties to the earlier; `most` bounds a party's seats.

    Starts from what every party has surely won and hands out the rest one by one, so the work is
    in the number of parties, not of seats.
    """
    most = most or [seats] * len(shares)
    total = sum(shares)
    if not total or not seats:
        return [0] * len(shares)
    # a party wins share / d rounded, and d can't be so large that the rounding loses more than half a seat for each party
    won = [min(m, max(0, int(s / total * (seats - Fraction(len(shares), 2)) - Fraction(1, 2)))) for s, m in zip(shares, most, strict=True)]
    queue = [(-s / (2 * w + 1), i) for i, (s, w, m) in enumerate(zip(shares, won, most, strict=True)) if w < m and s]
    heapq.heapify(queue)
    left = seats - sum(won)
    while left and queue:
        _, i = heapq.heappop(queue)
        won[i] += 1
        left -= 1
        if won[i] < most[i]:
            heapq.heappush(queue, (-shares[i] / (2 * won[i] + 1), i))
    return won


@dataclass
class Quota:
    """How a source's blocks are taken: `whole` times all of them, and in each shard `picked[j]` of its `blocks[j]` once more."""

    size: int
    target: Fraction
    whole: int
    blocks: list[int]
    picked: list[int]
    step: list[int]
    shift: list[int]


def plan(sizes: list[int], block: int, shards: int, seed: int, weights: tuple[int, ...] = WEIGHTS) -> list[Quota]:
    """Quotas of the sources in their order."""
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    own = [-(-s // block) for s in sizes]
    shards = max(shards, (max(own, default=0) >> 30) + 1)  # keeps step * block within 62 bits
    wanted = round(sum(aims) / block)
    won = sainte_lague(aims, wanted, [MOST_REPEATS * n for n in own])
    out = []
    for k, (size, aim, n, q) in enumerate(zip(sizes, aims, own, won, strict=True)):
        whole, rest = divmod(q, n) if n else (0, 0)
        blocks = [n // shards + (j < n % shards) for j in range(shards)]
        picked = sainte_lague([Fraction(b) for b in blocks], rest, blocks)
        step, shift = [], []
        for j, b in enumerate(blocks):
            a = (0x9E3779B1 * (seed + 1) + 7919 * k + 104729 * j) % max(b, 1) or 1
            while gcd(a, max(b, 1)) != 1:
                a += 1
            step.append(a % max(b, 1))
            shift.append((0x85EBCA6B * (seed + 3) + 31337 * k + 271 * j) % max(b, 1))
        out.append(Quota(size, aim, whole, blocks, picked, step, shift))
    return out


def picks(quota: Quota, block: int) -> bool:
    """Whether the source's block of this number is picked in the last, partial round (the rule that the DataFrame expression has too)."""
    j, i, shards = block % len(quota.blocks), block // len(quota.blocks), len(quota.blocks)
    return shards > 0 and (quota.step[j] * i + quota.shift[j]) % max(quota.blocks[j], 1) < quota.picked[j]


def source_key(source: Column) -> Column:
    """A name of a source that isn't null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def positions(sized: DataFrame) -> tuple[DataFrame, list]:
    """(sized rows with `at`, sources with their sizes in order) of rows with row_id, row_source, key (source_key()), size, tie and chunk.

    at: words of the source before the row, in the order of (id, tie). The driver holds one row per source.
    """
    by_chunk = sized.groupBy("row_source", "key", "chunk").agg(F.sum("size").alias("n"))
    by_chunk = materialize(by_chunk, "by_chunk")
    sources = by_chunk.groupBy("row_source").agg(F.sum("n").alias("n")).orderBy(F.col("row_source").asc_nulls_last()).collect()
    before = F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    base = by_chunk.select("key", "chunk", before.alias("base"))
    rel = F.sum("size").over(Window.partitionBy("key", "chunk").orderBy("row_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = sized.withColumn("rel", rel).join(base, ["key", "chunk"])
    return placed.withColumn("at", F.col("base") + F.col("rel")).drop("rel", "base"), [(r[0], r[1]) for r in sources]


QUOTA_TYPE = "source string, source_size long, target double, whole int, blocks array<bigint>, picked array<bigint>, step array<bigint>, shift array<bigint>"


def block_words(block: Column, at: Column, size: Column, width: int) -> Column:
    """Words that a document at this place of the stream has in a block."""
    return F.least((block + 1) * width, at + size) - F.greatest(block * width, at)


def picked_blocks(width: int, shards: int) -> Column:
    """Numbers of the picked blocks that the document reaches into (columns at, size, blocks, picked, step, shift)."""
    first, last = F.floor(F.col("at") / width).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / width).cast("long")
    every = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def chosen(b: Column) -> Column:
        j = (b % shards).cast("int")
        own = F.greatest(F.get("blocks", j), F.lit(1).cast("long"))
        return (F.get("step", j) * F.floor(b / shards) + F.get("shift", j)) % own < F.get("picked", j)

    return F.filter(every, chosen)


def _taken(docs: DataFrame, rows: DataFrame, weights: tuple[int, ...], block: int, shards: int, seed: int) -> DataFrame:
    """rows (of positions()) with the quota of their source, and `picked_at`: the numbers of the picked blocks a row reaches into."""
    placed, sources = positions(rows)
    quotas = plan([n for _, n in sources], block, shards, seed, weights)
    made = [(s if s is None else str(s), q.size, float(q.target), q.whole, q.blocks, q.picked, q.step, q.shift) for (s, _), q in zip(sources, quotas, strict=True)]
    table = docs.sparkSession.createDataFrame(made, QUOTA_TYPE).select(source_key(F.col("source")).alias("key"), "source_size", "target", "whole", "blocks", "picked", "step", "shift")
    shards = len(quotas[0].blocks) if quotas else shards
    if len(made) * (4 * shards + 10) * 8 < 8 << 20:
        table = F.broadcast(table)
    return placed.join(table, "key").withColumn("picked_at", picked_blocks(block, shards))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    chunks = Chunks(docs.select(id_col), id_col, CHUNK)
    source = F.col(source_col)
    rows = docs.select(F.col(id_col).alias("row_id"), source.alias("row_source"), source_key(source).alias("key"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), *more)
    return rows.withColumn("chunk", chunks.of(F.col("row_id"), F.col("tie")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = 17,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, whole, at, picked_at) of each row.

    size: words; taken: words the mix takes, repeats counted: `whole` times all of them and once more those
    in the picked blocks (`picked_at`: their numbers, `at`: the row's place in its source's stream).
    Sources in code point order, null last, have the weights in turn. Rows without words take none; ties of the id
    are put in order by a hash of the text, equal rows are interchangeable, null ids come first; an empty table gives no rows; further columns aren't read.
    Same input and seed, same mix. The driver holds one row per source and one cut point per chunk.
    """
    chosen = _taken(docs, materialize(_sized(docs, id_col, text_col, source_col), "sizes"), weights, block, shards, seed)
    extra = F.aggregate("picked_at", F.lit(0).cast("long"), lambda s, b: s + block_words(b, F.col("at"), F.col("size"), block))
    return chosen.select(F.col("row_id").alias(id_col), F.col("row_source").alias(source_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"), "whole", "at", "picked_at")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars",
    weights: tuple[int, ...] = WEIGHTS, block: int = 1024, shards: int = SHARDS, seed: int = 17,
) -> DataFrame:
    """The mix itself, with the columns of `docs`: every row as often as it is taken whole, and once more the words of its picked blocks.

    Words of a part are joined by single spaces. A row of which nothing is taken goes; rows without words go, as they add nothing
    to any source. Repeated rows are taken each by its own place. `chars_col`, where the table has it, counts the text given out.
    Rows are shuffled once, by source and chunk, and carry their columns along.
    """
    chosen = _taken(docs, _sized(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row")), weights, block, shards, seed)
    text = F.col("row")[text_col]
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    parts = F.transform("picked_at", lambda b: F.slice(words, (F.greatest(b * block - F.col("at"), F.lit(0).cast("long")) + 1).cast("int"), block_words(b, F.col("at"), F.col("size"), block).cast("int")))
    none = F.array().cast("array<string>")
    part = F.when(F.size("picked_at") > 0, F.array(F.array_join(F.flatten(parts), " "))).otherwise(none)
    every = F.concat(F.when(F.col("size") > 0, F.array_repeat(text, F.col("whole"))).otherwise(none), part)
    given = chosen.select("row", F.explode(every).alias("given"))
    columns = {text_col: F.col("given")} | ({chars_col: F.length("given").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return given.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
