"""Folders watched as streams: new packed files decode as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import extension, stem
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files below `path`, as sources.files() gives them; any read_* function of sources takes it."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found.withColumns({"ext": extension(F.col("path")), "stem": stem(F.col("path"))})


def convert(stream: DataFrame, read: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Decodes a watched folder into a Parquet table, each file once; runs till all present files are done."""
    writer = read(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(target)
