"""Whole conversions: folders of packed assets to plain files and back, and audio projects to named waves.

Each is one plan a kind of file; `report` counts what worked, and faults stay rows beside the results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import sources as src
from ..operators.xact import first_writer_names
from ..sources import audio, images, xnb


def relative(path: Column, root: str) -> Column:
    """A file's path below `root`, without its extension; of a single file its bare name."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].strip("/")
    below = F.when(F.startswith(bare, F.lit(base + "/")), F.substring(bare, F.lit(len(base) + 2), F.length(bare))).otherwise(F.element_at(F.split(bare, "/"), -1))
    return F.regexp_replace(below, r"\.[^./]*$", "")


@F.pandas_udf(T.BinaryType())
def _png(kind, width, height, data):
    import pandas as pd

    def one(k, w, h, d):
        raster = d[: w * h * 4] if k == images.RGBA else images.dxt_decode(d, w, h, k)
        return images.png_encode(images.unpremultiply(raster), w, h)

    return pd.Series([None if d is None else one(int(k), int(w), int(h), d) for k, w, h, d in zip(kind, width, height, data)], dtype=object)


def unpack(spark: SparkSession, source: str, target: str, classes: dict | None = None) -> DataFrame:
    """Unpacks every container below `source` into `target` and returns (path, _error_code, _error) of each.

    A texture becomes .png, a map .tbin, an effect .cso, XML .xml, a sound effect .wav and .json, all else .json; header and manifest go to .config
    beside it, as pack() needs them. The rows are decoded once and kept as a table below `target`. A texture of a format that has no
    decoder, or of fewer bytes than its size takes, writes nothing and is reported.
    """
    kept = f"{target.rstrip('/')}/_rows"
    src.read_xnb(src.files(spark, source, "*.xnb"), classes).write.mode("overwrite").parquet(kept)
    rows = spark.read.parquet(kept)
    rel = relative(F.col("path"), source)
    form, size = F.col("texture.format"), (F.col("texture.width"), F.col("texture.height"))
    wanted = F.when(form == images.RGBA, size[0].cast("long") * size[1] * 4).when(form == images.DXT1, fn.dxt_bytes(*size, 8)).otherwise(fn.dxt_bytes(*size, 16))
    bad = F.when(F.col("texture").isNull(), None).when(~form.isin(images.RGBA, images.DXT1, images.DXT3, images.DXT5), "bad_format").when((size[0] <= 0) | (size[1] <= 0), "bad_value").when(F.length("texture.data") < wanted, "truncated")
    rows = rows.withColumn("_error_code", F.coalesce("_error_code", bad))
    good = rows.where("_error_code IS NULL")
    config = F.to_json(F.struct("target", "format_version", "compressed_flag", "hidef", "readers", "extension", F.col("texture.format").alias("format")))
    rel = relative(F.col("path"), source)
    image = good.where("texture IS NOT NULL").select(F.concat(rel, F.lit(".png")).alias("rel_path"), _png("texture.format", "texture.width", "texture.height", "texture.data").alias("content"))
    blob = good.where("data IS NOT NULL").select(F.concat(rel, F.lit("."), "extension").alias("rel_path"), F.col("data").alias("content"))
    suffix = F.when(F.col("extension") == "xml", ".xml").otherwise(".json")
    text = good.where("content IS NOT NULL AND extension <> 'wav'").select(F.concat(rel, suffix).alias("rel_path"), F.encode("content", "UTF-8").alias("content"))
    sounds = src.sound_pairs(good)
    sounds = sounds.select(F.concat(rel, F.lit(".wav")).alias("rel_path"), F.col("wave").alias("content")).unionByName(sounds.select(F.concat(rel, F.lit(".json")).alias("rel_path"), F.encode("json", "UTF-8").alias("content")))
    configs = good.select(F.concat(rel, F.lit(".config")).alias("rel_path"), F.encode(config, "UTF-8").alias("content"))
    src.write_files(image.unionByName(blob).unionByName(text).unionByName(sounds).unionByName(configs), target)
    return rows.select("path", "_error_code", "_error")


def pack(spark: SparkSession, source: str, target: str, classes: dict | None = None, compress: bool = False) -> DataFrame:
    """Packs what unpack() wrote: .config files joined with their payloads by stem, containers written to `target`.

    Returns (path, _error_code, _error) of each; what can't be packed is a row with its reason and writes nothing. The rows are kept as a table below `target`.
    """
    found = src.files(spark, source).where(~F.col("path").contains("/_rows/") & ~F.col("path").contains("/_packed/")).select(relative(F.col("path"), source).alias("rel"), "ext", "content")
    config = "target string, format_version int, compressed_flag int, hidef boolean, readers array<struct<type:string,version:bigint>>, extension string, format int"
    heads = found.where("ext = '.config'").select("rel", F.from_json(F.decode("content", "UTF-8"), config).alias("head"))
    parts = found.where("ext IN ('.png', '.json', '.xml', '.cso', '.tbin', '.wav')").groupBy("rel").agg(F.map_from_entries(F.collect_list(F.struct("ext", "content"))).alias("parts"))

    def container(head: dict, given: dict) -> bytes:
        row = head | {"texture": None, "data": None, "content": None}
        if ".png" in given:
            width, height, raster = images.png_decode(given[".png"])
            raster = images.premultiply(raster)
            kind = head["format"] or 0
            data = raster if kind == images.RGBA else images.dxt_encode(raster, width, height, kind)
            row["texture"] = {"format": kind, "width": width, "height": height, "data": data}
        row["data"] = given.get(".cso", given.get(".tbin"))
        text = given.get(".json", given.get(".xml"))
        row["content"] = None if text is None else text.decode()
        if ".wav" in given:
            wave = audio.parse_wave(given[".wav"])
            row["content"] = json.dumps(json.loads(row["content"]) | {"fmt": audio.format_bytes(wave).hex(), "data": wave["data"].hex()})
        return xnb.build(row, classes, compress)

    def made(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rel, head, given = (batch.column(c)[i].as_py() for c in ("rel", "head", "parts"))
                data = code = why = None
                try:
                    data = container(head, dict(given))
                except src.FAULTS as e:
                    code, why = getattr(e, "code", "bad_value"), str(e)
                yield {"rel_path": rel + ".xnb", "content": data, "_error_code": code, "_error": why}, len(data or b"")

    def run(batches):
        import pyarrow as pa

        return src.in_batches(made(batches), pa.schema({"rel_path": pa.string(), "content": pa.binary(), "_error_code": pa.string(), "_error": pa.string()}))

    kept = f"{target.rstrip('/')}/_packed"
    heads.join(parts, "rel").mapInArrow(run, "rel_path string, content binary, _error_code string, _error string").write.mode("overwrite").parquet(kept)
    rows = spark.read.parquet(kept)
    src.write_files(rows.select("rel_path", "content"), target)
    return rows.select(F.col("rel_path").alias("path"), "_error_code", "_error")


def report(rows: DataFrame) -> DataFrame:
    """Files decoded, failed and in all."""
    return rows.agg(F.count_if(F.col("_error_code").isNull()).alias("success"), F.count("_error_code").alias("fail"), F.count("*").alias("total"))


def name_project(cues: DataFrame, entries: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Names the entries of all wave banks by the cues that play them.

    cues: sources.cue_waves(), cues of different sound banks (path) are different ones; entries: sources.wave_entries(), of banks with one name the last
    path counts; categories: (path, category_id, name) of engines, the last path counts. The first cue in order names a wave, with a number where the cue has several sounds;
    waves that no cue plays take their number in eight hexadecimal digits. Adds cue_name, category and name.
    """
    sounds = cues.groupBy(F.col("path").alias("cue_path"), "cue_ord").agg((F.countDistinct("sound_ord") > 1).alias("several"))
    used = cues.withColumnRenamed("path", "cue_path").join(sounds, ["cue_path", "cue_ord"])
    used = used.withColumns({"clip_ord": F.coalesce("clip_ord", F.lit(0)), "event_ord": F.coalesce("event_ord", F.lit(0))})
    named = first_writer_names(used, ["bank_name", "track_index"], ["cue_path", "cue_ord"], ["sound_ord", "clip_ord", "event_ord"], F.col("cue_name"), F.col("several"), ["cue_name", "category_id"])
    named = named.select("bank_name", F.col("track_index").alias("entry_idx"), "cue_name", "category_id", F.col("name").alias("_name"))
    loaded = Window.partitionBy("bank_name").orderBy(F.desc("path"))
    last = entries.withColumn("_load", F.dense_rank().over(loaded)).select(entries["*"], (F.col("_load") == 1).alias("_last"))
    out = last.join(named.withColumn("_last", F.lit(True)), ["bank_name", "entry_idx", "_last"], "left").drop("_last")
    out = out.withColumn("name", F.coalesce("_name", fn.default_name(F.col("entry_idx")))).drop("_name")
    if categories is None:
        return out.withColumn("category", F.lit(None).cast("string")).drop("category_id")
    own = categories.join(categories.agg(F.max("path").alias("path")), "path")
    return out.join(own.select("category_id", F.col("name").alias("category")), "category_id", "left").drop("category_id")


def unpack_project(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Waves of the audio project in `source` as files bank/name.wav below `target`; returns their names without bytes."""
    entries = src.wave_entries(src.read_xwb(src.files(spark, source, "*.xwb")))
    cues = src.cue_waves(src.read_xsb(src.files(spark, source, "*.xsb")))
    categories = src.read_xgs(src.files(spark, source, "*.xgs")).select("path", F.explode("categories").alias("c")).select("path", "c.*")
    named = name_project(cues, entries, categories)
    wave = src._wave("data", "codec", "channels", "rate", "align", "bits")
    src.write_files(named.select(F.concat("bank_name", F.lit("/"), "name", F.lit(".wav")).alias("rel_path"), wave.alias("content")), target)
    return named.drop("data")
