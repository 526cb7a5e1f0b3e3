"""Helpers that several operators share: shared storage, bounded Arrow batches, ordered chunks, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches are cut at about so many bytes (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the driver is the only machine (master local), a folder of our own that is removed at the end; on a cluster an error.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/{name}"


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers are reused, and what one stage held would count in all that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches cut by bytes, too (for the rest of the session, unless it says otherwise)."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose sizes add up to `most` at most (a larger row is a slice of its own)."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def text_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text of a column; null: 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of a column; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Removes the shuffle files of a finished write; what was written is what later stages read.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Chunks:
    """Cuts of a table into chunks of about `rows` rows that follow one another in the order of (id, tie); null ids come first.

    The cuts are literals from then on, so a retried task puts each row into the same chunk. An id that fills several chunks
    is cut by its tie (a hash of the row's text). No chunk is ever held in memory: 65,536 chunks at most only means that those of very large
    tables have more rows.
    """

    def __init__(self, df: DataFrame, key: str, rows: int):
        counted = df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
        n, nulls = counted["n"], counted["nulls"]
        self.width = max(rows, -(-n // 65_536))
        self.edges: list[int] = []
        self.nulls = -(-nulls // self.width)
        parts = -(-(n - nulls) // self.width)
        if parts > 1:
            found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100_000).alias("p")).first()["p"]
            self.edges = sorted(int(x) for x in found)
        self.repeats = len(set(self.edges)) < len(self.edges)

    @property
    def count(self) -> int:
        return len(self.edges) + 1 + self.nulls

    def _below(self, key: Column, or_equal: bool) -> Column:
        """How many cuts lie below the key (or at it)."""
        array = F.split(F.lit(",".join(map(str, self.edges))), ",").cast("array<bigint>")  # folds to one literal
        steps = F.sequence(F.lit(0), F.lit(len(self.edges).bit_length() - 1))

        def halve(s: Column, _: Column) -> Column:
            mid = ((s["lo"] + s["hi"]) / 2).cast("int")
            at = F.get(array, mid)
            up = (at <= key) if or_equal else (at < key)
            return F.when(s["lo"] >= s["hi"], s).when(up, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(self.edges)).alias("hi")), halve, lambda s: s["lo"])

    def of(self, key: Column, tie: Column) -> Column:
        """The chunk number of a row; `tie` is a 64-bit integer."""
        share = tie / F.lit(2.0**64) + 0.5
        within = self._below(key, False) if self.edges else F.lit(0)
        if self.repeats:
            within = within + F.floor(share * (self._below(key, True) - within).cast("double")).cast("int")
        chunk = F.lit(self.nulls) + within
        if self.nulls:
            chunk = F.when(key.isNull(), F.least(F.floor(share * self.nulls).cast("int"), F.lit(self.nulls - 1))).otherwise(chunk)
        else:
            chunk = F.coalesce(chunk, F.lit(0))
        return chunk.cast("int")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links(a, b): component_id is the smallest id it reaches.

    Alternates large-star and small-star steps until nothing changes, which takes about the logarithm of the longest path. A round is three shuffles of the
    links that are left, written to the shared folder; nothing but a count and two checksums a round reaches the driver.
    Hubs are no problem: a step gives each link one minimum, it never pairs the neighbours of a node.
    """
    state = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1))))
    by_node = Window.partitionBy("u")
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = tuple(edges.agg(*state).first())
    while True:
        # large star: link every larger neighbour of u to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.withColumn("m", F.least(F.min("v").over(by_node), F.col("u")))
        large = low.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: link u and every smaller neighbour of u to the smallest of them
        down = large.withColumn("m", F.min("v").over(by_node))
        small = down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        after = materialize(small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
        now = tuple(after.agg(*state).first())
        discard(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many underscores behind it as it takes to differ from all taken ones, whatever their case."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name
