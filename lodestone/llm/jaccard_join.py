"""N-gram Jaccard join (3): links between texts whose sets of word n-grams are similar enough, by PartEnum signatures.

Equal sets count as one set, so copies are never paired. Every set gives its signatures; a group is the sets of one
signature. Within a group, parity sketches rule out what can't be similar (never what is); of the rest each
set names its nearest few in other components, these pairs are verified on the whole sets, and verified
links join components. The components are exact while a group of n similar sets costs about n pairs, not n * n:

1. of each set's first few groups, in an order of hashes, blocks of BLOCK sets are compared within themselves: near copies meet here for the most part;
2. of groups larger than a block, one set of each component is compared with those of others, twice at most: this only saves work in step 3;
3. in every group that still has several components, sets of different ones are compared. In groups larger than a block, the sets outside of the largest
   component are compared with all of the group, block by block, each block in a task of its own. Every set names up to NEAREST partners; where one has more, step 3
   is done again with four times as many, so a large group of sets just below the threshold ends too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, free_name, map_arrow, materialize, slices, text_sizes, texts_of
from .partenum import fold, possible, signatures, sketches
from .textops import U64, mix, shingles

BLOCK = 1024
#: Groups of each set in step 1.
FIRST_GROUPS = 4
#: Partners that a set names in step 1, in blocks of large groups, and at first in step 3.
FIRST_NEAREST, BLOCK_NEAREST, NEAREST = 1, 8, 1024
#: 64-bit words of sketches that are compared at once.
WORDS_AT_ONCE = 1 << 20
#: Bytes of texts that are shingled at once.
SLICE_BYTES = 1 << 19
#: A task forgets the sets it has signed after so many; this only saves shuffling the signatures of copies.
MOST_SEEN = 100_000
#: Ids and pairs of ids up to so many are broadcast (16 bytes each); more are joined by shuffle.
MOST_BROADCAST = 500_000


def _set_keys(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    ends = np.cumsum(sizes)
    keys = []
    for seed in (71, 73):
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(elements, seed), dtype=U64)])
        keys.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64), seed + 1).view(np.int64))
    return keys[0], keys[1]


def set_keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, tie, n_shingles, k, k2, sketch) of (doc_id, tie, text) rows: the size of each text's set, two hashes of it and its sketch (null k: an empty set)."""
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("tie long, n_shingles long, k long, k2 long, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_sizes(whole.column(2)), SLICE_BYTES):
                elements, sizes = shingles(texts_of(batch.column(2)), n)
                k, k2 = _set_keys(elements, sizes)
                columns = [pa.array(sizes, pa.int64()), pa.array(k, pa.int64(), mask=sizes == 0), pa.array(k2, pa.int64()), pa.array(sketches(elements, sizes, percent), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], out.names)

    return map_arrow(docs.select("doc_id", "tie", "text"), run, out)


def signature_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, k): the signatures of each set; a task signs for copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, text_sizes(whole.column(0)), SLICE_BYTES):
                texts = list(dict.fromkeys(texts_of(batch.column(0))))
                elements, sizes = shingles(texts, n)
                k, _ = _set_keys(elements, sizes)
                if len(seen) > MOST_SEEN:
                    seen.clear()
                fresh = np.zeros(len(k), dtype=bool)
                for i, key in enumerate(k.tolist()):
                    fresh[i] = key not in seen
                    seen.add(key)
                sig, owner = signatures(elements[np.repeat(fresh, sizes)], sizes[fresh], percent)
                k = k[fresh]
                for part in range(0, len(sig), 100_000):
                    end = part + 100_000
                    yield pa.RecordBatch.from_arrays([pa.array(sig[part:end].view(np.int64)), pa.array(k[owner[part:end]])], ["sig", "k"])

    return map_arrow(docs.select("text"), run, "sig long, k long")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, k, members, rank) of the signatures that two different sets or more have; rank counts a set's signatures in an order of hashes."""
    own, ordered = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy("k")
    rows = rows.withColumn("before", F.lag("k").over(ordered)).withColumn("low", F.min("k").over(own)).withColumn("high", F.max("k").over(own))
    rows = rows.where("low < high AND (before IS NULL OR before <> k)").select("sig", "k")
    return rows.withColumn("members", F.count("*").over(own)).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("sig"))))


def _joined(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins to a table of ids or pairs that is broadcast where a count shows that it has MOST_BROADCAST rows at most."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, on, how)


def texts_of_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, text) of one document of each wanted set: its representative."""
    key, own = free_name(docs.columns, "own"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = materialize(_joined(docs.withColumn(key, own), wanted.select("k", own.alias(key), "tie"), [key, "tie"]).select("k", "text"), "texts")
    if found.count() == wanted.count():
        return found
    one = materialize(found.dropDuplicates(["k"]), "texts")  # rows of one id and text
    discard(found)
    return one


class _Members:
    """Sets of one group: (key, component, size, sketch)."""

    def __init__(self, rows: list[tuple]):
        self.keys, self.comps, self.sizes = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(3))
        self.sketches = [r[3] for r in rows]
        self.words = min(len(s) // 8 for s in self.sketches)

    def matrix(self, words: int) -> np.ndarray:
        return np.stack([fold(s, words) for s in self.sketches])


def _name_nearest(some: _Members, every: _Members, chosen: np.ndarray, percent: int, nearest: int, out: set) -> None:
    """Adds to `out` (set, partner, bits) for each of the chosen members of `some` its nearest possible partners of other components among `every`."""
    words = min(some.words, every.words)
    left, right = some.matrix(words), every.matrix(words)
    step = max(1, WORDS_AT_ONCE // (words * len(right)))
    for at in range(0, len(chosen), step):
        part = chosen[at : at + step]
        may, bits = possible(right[None], left[part][:, None], every.sizes[None], some.sizes[part][:, None], percent)
        may &= every.comps[None] != some.comps[part][:, None]
        for row in np.flatnonzero(may.any(axis=1)):
            i, found = part[row], np.flatnonzero(may[row])
            for j in found[np.lexsort((every.keys[found], bits[row, found]))[:nearest]]:
                out.add((int(some.keys[i]), int(every.keys[j]), int(bits[row, j])))


def _near_pairs(table: pa.Table, percent: int, nearest: int) -> list[tuple[int, int, int]]:
    """(set, partner, bits) for the sets of whole groups, given one after the other: each one's nearest possible partners of other components in its group."""
    sig, k, comp, n = (table.column(c).to_numpy() for c in ("sig", "k", "comp", "n"))
    ends = np.append(np.flatnonzero(np.diff(sig)) + 1, len(sig))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    flat, offsets = _flat(table.column("sketch"))
    words = np.diff(offsets)
    partners = end - 1 - np.arange(len(sig))  # later ones in the group
    found: list[tuple[np.ndarray, ...]] = []
    total = np.cumsum(partners)
    first = 0
    while first < len(sig):  # rows whose pairs are some 65,536 together
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + (1 << 16))))
        own = np.arange(first, last)
        i = np.repeat(own, partners[own])
        j = np.arange(len(i)) - np.repeat(np.cumsum(partners[own]) - partners[own], partners[own]) + i + 1
        first = last
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        use = (comp[i] != comp[j]) & (100 * small >= percent * large)
        i, j = i[use], j[use]
        for a in np.unique(words[i]):
            for b in np.unique(words[j]):
                here = np.flatnonzero((words[i] == a) & (words[j] == b))
                step = max(1, WORDS_AT_ONCE // int(a + b))
                for at in range(0, len(here), step):
                    x, y = i[here[at : at + step]], j[here[at : at + step]]
                    left, right = _fold_rows(flat[offsets[x][:, None] + np.arange(a)], int(min(a, b))), _fold_rows(flat[offsets[y][:, None] + np.arange(b)], int(min(a, b)))
                    may, bits = possible(left, right, n[x], n[y], percent)
                    found.append((x[may], y[may], bits[may]))
    if not found:
        return []
    x, y, bits = (np.concatenate(c) for c in zip(*found, strict=True))
    x, y, bits = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([bits, bits])
    order = np.lexsort((k[y], bits, x))
    x, y, bits = x[order], y[order], bits[order]
    begin = np.flatnonzero(np.diff(x, prepend=-1))
    keep = np.arange(len(x)) - np.repeat(begin, np.diff(begin, append=len(x))) < nearest
    return list(zip(k[x[keep]].tolist(), k[y[keep]].tolist(), bits[keep].tolist(), strict=True))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all values, place of each value's first word, and the end)."""
    values = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = np.array(text_sizes(values), dtype=np.int64) // 8
    return np.frombuffer(b"".join(texts_of(values)), dtype="<u8"), np.concatenate([[0], np.cumsum(sizes)])


def _fold_rows(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


PAIRS = "k long, other long, bits long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["k", "other", "bits"])


def pairs_of_small(members: DataFrame, percent: int, nearest: int) -> DataFrame:
    """(k, other, bits) of groups of at most BLOCK sets, from (sig, k, comp, n, sketch) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            sig = table.column("sig").to_numpy()
            others = np.flatnonzero(sig != sig[-1])
            last = int(others[-1]) + 1 if len(others) else 0
            rest = table.slice(last)
            out = _near_pairs(table.slice(0, last).combine_chunks(), percent, nearest) if last else []
            for at in range(0, len(out), 50_000):
                yield _batch(out[at : at + 50_000])
        if rest is not None and (out := _near_pairs(rest.combine_chunks(), percent, nearest)):
            yield _batch(out)

    members = members.select("sig", "k", "comp", "n", "sketch").repartition("sig").sortWithinPartitions("sig", "k")
    return map_arrow(members, run, PAIRS)


def pairs_of_blocks(members: DataFrame, percent: int, nearest: int) -> DataFrame:
    """(k, other, bits) of blocks of larger groups, from (sig, block, guest, k, comp, n, sketch, searches) rows.

    A block's own sets are compared with each other, and each guest with the block's own; of the own ones those search that `searches` says, and
    every guest does. A block holds about BLOCK sets of its own at once, guests pass by.
    """
    members = members.select("sig", "block", "guest", "k", "comp", "n", "sketch", "searches").repartition("sig", "block").sortWithinPartitions("sig", "block", "guest", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        own: _Members | None = None
        held: list[tuple] = []
        search: list[bool] = []
        out: set = set()

        def settle() -> None:
            """Compares what is held: the block's own sets first, later its guests."""
            nonlocal own
            if held and own is None:
                own = _Members(held)
                if len(set(own.comps.tolist())) > 1:
                    _name_nearest(own, own, np.flatnonzero(search), percent, nearest, out)
            elif held:
                _name_nearest(_Members(held), own, np.arange(len(held)), percent, nearest, out)
            held.clear()
            search.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for sig, block, guest, *row, searches in zip(*(c.to_pylist() for c in whole.slice(at, 1024).columns), strict=True):
                    if (sig, block) != key:
                        settle()
                        key, own = (sig, block), None
                    elif guest and own is None or len(held) >= 4 * BLOCK and own is not None:
                        settle()
                    if len(out) > 50_000:
                        yield _batch(sorted(out))
                        out.clear()
                    if not guest or own is not None:  # a block without sets of its own has nothing for guests
                        held.append(tuple(row))
                        search.append(searches)
        settle()
        if out:
            yield _batch(sorted(out))

    return map_arrow(members, run, PAIRS)


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, ok): whether 100 * |a & b| >= percent * |a | b|, on the sets of the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [x + y for x, y in zip(text_sizes(whole.column(2)), text_sizes(whole.column(3)), strict=True)]
            for batch in slices(whole, sizes, SLICE_BYTES):
                ok, (x, nx), (y, ny) = [], *(shingles(texts_of(batch.column(c)), n) for c in (2, 3))
                for left, right in zip(np.split(x, np.cumsum(nx)[:-1]), np.split(y, np.cumsum(ny)[:-1]), strict=True):
                    both = np.concatenate([left, right])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * common >= percent * (len(both) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    left = _joined(texts.select(F.col("k").alias("a"), F.col("text").alias("x")), pairs, ["a"])
    right = _joined(texts.select(F.col("k").alias("b"), F.col("text").alias("y")), pairs.select("b").distinct(), ["b"], "left_semi")
    return map_arrow(left.join(right, "b").select("a", "b", "x", "y"), run, "a long, b long, ok boolean")


class _Search:
    """The rounds that find the components of sets: `comps` (id, component_id) of linked sets, None before the first link."""

    def __init__(self, shared: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int):
        self.small, self.large = shared.where(F.col("members") <= BLOCK), shared.where(F.col("members") > BLOCK)
        self.sets, self.texts, self.n, self.percent = sets, texts, n, percent
        self.comps: DataFrame | None = None
        self.checked: list[DataFrame] = []

    def placed(self, rows: DataFrame) -> DataFrame:
        """Adds each set's component."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("k"))
        return rows.join(self.comps.select(F.col("id").alias("k"), F.col("component_id").alias("comp")), "k", "left").withColumn("comp", F.coalesce("comp", "k"))

    def described(self, members: DataFrame) -> DataFrame:
        """Adds each set's size and sketch."""
        return members.join(self.sets, "k")

    def round(self, found: DataFrame, nearest: int) -> tuple[bool, bool]:
        """Verifies the nearest of the named partners (k, other, bits) of each set; (whether some set has more, whether a pair linked)."""
        place = F.row_number().over(Window.partitionBy("k").orderBy("bits", "other"))
        named = materialize(found.distinct().withColumn("place", place).where(F.col("place") <= nearest + 1), "named")
        more = bool(named.where(F.col("place") > nearest).limit(1).count())
        pairs = materialize(named.where(F.col("place") <= nearest).select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).distinct(), "pairs")
        checked = materialize(verify(pairs, self.texts, self.n, self.percent), "checked")
        discard(named)
        discard(pairs)
        linked = bool(checked.where("ok").limit(1).count())
        self.checked.append(checked)
        if linked:
            before, self.comps = self.comps, components(reduce(DataFrame.union, self.checked).where("ok").select("a", "b"))
            if before is not None:
                discard(before)
        return more, linked

    def blocks(self, rows: DataFrame, members: str, seed: int) -> DataFrame:
        """Rows of a group in blocks of about BLOCK sets, dealt by hash; every one searches, in its own block."""
        block = F.pmod(F.xxhash64("k", F.lit(seed)), F.ceil(F.col(members) / BLOCK)).cast("int")
        return rows.withColumns({"block": block, "guest": F.lit(False), "searches": F.lit(True)})

    def run(self) -> None:
        has_large = bool(self.large.limit(1).count())
        first = pairs_of_small(self.described(self.placed(self.small.where(F.col("rank") <= FIRST_GROUPS))), self.percent, FIRST_NEAREST + 1)
        if has_large:
            own = self.blocks(self.placed(self.large.where(F.col("rank") <= FIRST_GROUPS)), "members", 0)
            first = first.union(pairs_of_blocks(self.described(own), self.percent, BLOCK_NEAREST))
        _, linked = self.round(first, BLOCK_NEAREST if has_large else FIRST_NEAREST)
        for turn in (1, 2) if has_large else ():
            if linked:
                groups = self.placed(self.large).groupBy("sig", "comp").agg(F.min("k").alias("k"))  # one set of each component
                sizes = groups.groupBy("sig").agg(F.count("*").alias("left")).where("left > 1")
                _, linked = self.round(pairs_of_blocks(self.described(self.blocks(groups.join(sizes, "sig"), "left", turn)), self.percent, BLOCK_NEAREST), BLOCK_NEAREST)
        more, nearest = True, NEAREST
        while more:
            every = Window.partitionBy("sig")
            small = self.placed(self.small).select("sig", "k", "comp", F.min("comp").over(every).alias("low"), F.max("comp").over(every).alias("high")).where("low < high")
            found = pairs_of_small(self.described(small.select("sig", "k", "comp")), self.percent, nearest + 1)
            if has_large:
                found = found.union(pairs_of_blocks(self.described(self.guests()), self.percent, nearest + 1))
            more, _ = self.round(found, nearest)
            nearest *= 4

    def guests(self) -> DataFrame:
        """Sets of the large groups that have several components: each in its block, and those outside of the group's largest component as guests in all others."""
        members = self.placed(self.large)
        open_ = members.groupBy("sig", "comp").agg(F.count("*").alias("c")).groupBy("sig").agg(F.count("*").alias("several"), F.max(F.struct("c", "comp"))["comp"].alias("major")).where("several > 1")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        members = members.join(open_, "sig").withColumn("own", F.pmod(F.xxhash64("k"), blocks).cast("int")).withColumn("searches", F.col("comp") != F.col("major"))
        members = members.withColumn("block", F.explode(F.when(F.col("searches"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
        return members.withColumn("guest", F.col("block") != F.col("own"))


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, tie, n_shingles, comp, component_id) of (doc_id, tie, text) rows, written out. comp: a key of the component (null: no words); component_id: its smallest id."""
    keys = materialize(set_keys(docs, n, percent), "set_keys")
    reps = keys.where("k IS NOT NULL").groupBy("k").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first"), F.min("k2").alias("low"), F.max("k2").alias("high"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
    )
    reps = materialize(reps.select("k", F.col("first.doc_id").alias("rep"), F.col("first.tie").alias("tie"), "low", "high", "n", "sketch"), "sets")
    if reps.where("low <> high").limit(1).count():
        raise ValueError("two different sets share a 64-bit hash; change the seeds")
    shared = materialize(shared_signatures(signature_rows(docs, n, percent)), "shared")
    wanted = materialize(reps.join(shared.select("k").distinct(), "k", "left_semi").select("k", F.col("rep").alias("doc_id"), "tie", "n", "sketch"), "wanted")
    texts = texts_of_sets(docs, wanted)
    search = _Search(shared, wanted.select("k", "n", "sketch"), texts, n, percent)
    search.run()
    rep = search.placed(reps.select("k", "rep"))
    least = rep.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = rep.join(least, "comp").select("k", "comp", "component_id")
    keys = keys.select("doc_id", "tie", "n_shingles", "k")
    some = keys.where("k IS NOT NULL").join(named, "k", "left").select("doc_id", "tie", "n_shingles", "comp", "component_id")
    none = keys.where("k IS NULL").select("doc_id", "tie", "n_shingles", F.col("k").alias("comp"), F.col("doc_id").alias("component_id"))
    made = materialize(some.unionByName(none), "classes")
    for x in [keys, reps, shared, wanted, texts, *search.checked, *([search.comps] if search.comps is not None else [])]:
        discard(x)
    return made


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: the set's size and the smallest id reachable by links.

    Two texts link when 100 * |a & b| >= percent * |a | b| for their sets of n-word shingles (A-Z as a-z). A text with fewer
    words has its whole sequence as one shingle; null, empty and blank texts have no set, link with nothing and
    are their own component. Repeated rows and copies link with each other. Rows without an id link as others do; a component in which
    none has an id is null. An empty table gives no rows; further columns aren't read. The driver holds no documents, links or components:
    only whether a round found pairs.
    """
    found = classes(_keyed(docs, id_col, text_col), n, percent)
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those that reach a smaller id by links.

    Of each group the document of the smallest id stays; rows without an id go where they reach one, and of a group without any the row of
    the least text hash stays. Texts without words stay. Rows of one id stay or go together, but of equal rows (id and text) one stays.
    """
    found = classes(_keyed(docs, id_col, text_col), n, percent)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    loose = found.where("doc_id IS NULL AND comp IS NOT NULL")
    first = loose.groupBy("comp").agg(F.min("tie").alias("first"))
    lost = materialize(loose.join(first, "comp").where("component_id IS NOT NULL OR tie <> first").select("tie").distinct(), "lost")
    tie, lone = free_name(docs.columns, "keep_tie"), free_name(docs.columns, "keep_lost")
    rows = docs.withColumn(tie, F.when(F.col(id_col).isNull(), F.xxhash64(text_col)))
    rows = rows.join(gone.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").join(lost.select(F.col("tie").alias(tie)), tie, "left_anti")
    repeated = found.where("comp IS NOT NULL").groupBy("doc_id", "tie").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(lone), F.col("tie").alias(tie))
    if repeated.limit(1).count():
        again = repeated.withColumn(lone, F.coalesce(F.col(lone).cast("string"), F.lit("")))
        rows = rows.withColumn(tie, F.xxhash64(text_col)).withColumn(lone, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        single = rows.join(again, [lone, tie], "left_anti")
        rows = single.unionByName(rows.join(again, [lone, tie], "left_semi").dropDuplicates([lone, tie]))
    return rows.select(*docs.columns)
