"""Joins, distincts and window-shaped loops that the asset operators share.

All of them are declarative: one shuffle on the key each, none gathers a group in Python, and explicit order
columns stand for the order of lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """Adds the row number within the keys' group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group: what a dictionary keeps if the first writer wins."""
    return numbered(df, keys, order, "_place").where("_place = 1").drop("_place")


def last_wins_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to a table whose keys may repeat: of the rows of a key the last loaded counts."""
    return left.join(first_of(right, [key], [F.desc(order)]), key, "left")


def first_match_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Inner join to the first matching template."""
    return left.join(first_of(right, keys, [F.asc(order)]), list(keys))


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join to a table of names by number. Whether it is broadcast is Spark's choice, by its size in bytes when the plan runs."""
    return df.join(table, key)


def pivoted_counts(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], suffix: str) -> DataFrame:
    """Counts of each kind by key in one shuffle: what a full outer join of one list per kind gives, where all come from one table. Null: none."""
    counts = [F.nullif(F.count_if(F.col(kind) == k), F.lit(0)).alias(f"{k}_{suffix}") for k in kinds]
    return df.where(F.col(kind).isin(*kinds)).groupBy(*keys).agg(*counts)


def matched_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The columns that a target has, by name and type; an error where one is missing or of another type."""
    known = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {n: t for n, t in fields.items() if known.get(n) != t}
    if wrong:
        raise ValueError(f"no fields for {wrong}")
    return df.select(*fields)


def keyed_map(df: DataFrame, keys: Sequence[str], key: str, value: str, name: str) -> DataFrame:
    """A map per group; a key that occurs twice in one is an error (Spark's default for maps)."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def keep_used(df: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(used.select(*keys).distinct(), list(keys), "left_semi")


def drop_bad(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(bad.select(*keys).distinct(), list(keys), "left_anti")


def merge_lists(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of keyed lists; every part's other columns get its name in front."""
    named = [df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys]) for name, df in parts.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), named)


def align_positions(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The values of all lists at one position, in the lists' order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(name))


def edges_without_loops(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.where(F.col(src) != F.col(dst)).select(src, dst).distinct()


def adjacency(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.groupBy(src).agg(F.array_sort(F.collect_set(dst)).alias("targets"))


def length_to_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, end: Column) -> Column:
    """Distance to the following row's value, of the last row to `end`."""
    return F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)), end) - value


def gap_before(keys: Sequence[str], order: Sequence[str], start: Column, length: Column) -> Column:
    """Space between the end of the row before and this one's start; null for the first."""
    return start - F.lag(start + length).over(Window.partitionBy(*keys).orderBy(*order))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Run-length coding: (keys, run, value, first, n) of each run of equal values (nulls are equal)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place = df.withColumn("_at", F.row_number().over(w) - 1)
    fresh = F.when((F.col("_at") == 0) | ~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    marked = place.withColumn("_new", fresh)
    grouped = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min("_at").alias("first"), F.count("*").alias("n"))


def carry_forward(keys: Sequence[str], order: Sequence[str], value: Column) -> Column:
    """The last value that isn't null so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def from_topmost(df: DataFrame, keys: Sequence[str], layer: Column, opaque: Column) -> DataFrame:
    """Rows at or above the topmost opaque layer of their cell; all rows of a cell that has none."""
    top = F.max(F.when(opaque, layer)).over(Window.partitionBy(*keys))
    return df.withColumn("_top", top).where(F.col("_top").isNull() | (layer >= F.col("_top"))).drop("_top")


def resample(interval: Column, frames: Column, tick: Column, length: Column) -> Column:
    """Frame number shown at each tick of an animation: steps of `tick` over `length`, wrapping at the frame count; none where a tick is longer."""
    steps = F.when(length >= tick, F.sequence(F.lit(0).cast("long"), F.floor(length / tick).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda i: F.floor(i * tick / interval).cast("long") % frames)


def first_key_union(parts: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Union of lists in order, of each key the first row."""
    tagged = [df.withColumn("_part", F.lit(i)) for i, df in enumerate(parts)]
    return first_of(reduce(lambda a, b: a.unionByName(b), tagged), keys, ["_part", order]).drop("_part")
