"""Tile-map transforms over the normal tables of sources.map_tables(): sheets, layers, tiles, frames and properties.

Lists of the format are rows with explicit places (layer_ord, pos, prop_ord), so every transform is a plan of filters, joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .relational import first_of, from_topmost

STRING = 3


def without_empty_strings(properties: DataFrame) -> DataFrame:
    """Properties but those of an empty string; a null stays."""
    return properties.where(~F.coalesce((F.col("type") == STRING) & (F.col("value_string") == ""), F.lit(False)))


def bare_images(sheets: DataFrame) -> DataFrame:
    """Sheets whose images are named without `.png`, wherever that stands."""
    return sheets.withColumn("image", F.replace("image", F.lit(".png"), F.lit("")))


def without_prefix(properties: DataFrame, prefix: str = "Custom_") -> DataFrame:
    """Strings of maps' and tiles' properties without a prefix, wherever it stands; those of sheets and layers stay."""
    own = F.col("owner_kind").isin("map", "tile") & (F.col("type") == STRING)
    return properties.withColumn("value_string", F.when(own, F.replace("value_string", F.lit(prefix), F.lit(""))).otherwise(F.col("value_string")))


def first_property(properties: Column, key: str) -> Column:
    """The value of the first property of an array<struct<key, value>> with this key."""
    return F.get(F.filter(properties, lambda p: p["key"] == key), F.lit(0))["value"]


def layer_names(layers: DataFrame, properties: DataFrame) -> DataFrame:
    """Layers with the name they are drawn under: their first Draw property, else their id."""
    drawn = properties.where("owner_kind = 'layer' AND key = 'Draw'").groupBy("path", "layer_ord").agg(F.min_by("value_string", "prop_ord").alias("draw"))
    return layers.join(drawn, ["path", "layer_ord"], "left").withColumn("name", F.coalesce("draw", "id")).drop("draw")


def sheet_tile_properties(sheets: DataFrame, properties: DataFrame) -> DataFrame:
    """Properties of sheets that belong to one tile, with its key: sheet@index, the index being the third part of the property's key."""
    own = properties.where("owner_kind = 'sheet'").join(sheets.select("path", "sheet_ord", F.col("id").alias("sheet")), ["path", "sheet_ord"])
    return own.withColumn("tile_key", fn.tile_key(F.col("sheet"), F.get(F.split("key", "@"), F.lit(2))))


def used_tiles(tiles: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, tile_sheet, tile_index) of every tile that is shown, alone or as a frame, once each."""
    cols = ["path", "tile_sheet", "tile_index"]
    return tiles.where("tile_sheet IS NOT NULL").select(*cols).union(frames.select(*cols)).distinct()


def used_properties(tile_properties: DataFrame, used: DataFrame) -> DataFrame:
    """Properties of sheets (with tile_key) whose tile is in use."""
    keys = used.select("path", fn.tile_key(F.col("tile_sheet"), F.col("tile_index")).alias("tile_key"))
    return tile_properties.join(keys, ["path", "tile_key"], "left_semi")


def merged_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets with the id of the first of their map that has the same image, in `merged_id`."""
    first = F.first("id").over(Window.partitionBy("path", "image").orderBy("sheet_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sheets.withColumn("merged_id", first)


def remapped(tiles: DataFrame, sheets: DataFrame) -> DataFrame:
    """Tiles on the merged sheets; a sheet that isn't known stays."""
    names = sheets.select("path", F.col("id").alias("tile_sheet"), "merged_id")
    return tiles.join(names, ["path", "tile_sheet"], "left").withColumn("tile_sheet", F.coalesce("merged_id", "tile_sheet")).drop("merged_id")


def with_tile_properties(tiles: DataFrame, tile_properties: DataFrame) -> DataFrame:
    """Tiles with `keys`, the property keys of their place on the sheet in order; an empty array where there are none."""
    lists = tile_properties.groupBy("path", "tile_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("prop_ord", "key"))), lambda p: p["key"]).alias("keys"))
    keyed = tiles.withColumn("tile_key", fn.tile_key(F.col("tile_sheet"), F.col("tile_index")))
    return keyed.join(lists, ["path", "tile_key"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))).drop("tile_key")


def layer_cells(wanted: DataFrame, layers: DataFrame, tiles: DataFrame) -> DataFrame:
    """wanted (path, name, x, y, ..) with the tile of that cell in the first layer of that name (null where it is empty); unknown layers drop out."""
    first = first_of(layers, ["path", "name"], ["layer_ord"]).select("path", "name", "layer_ord", "width")
    at = wanted.join(first, ["path", "name"]).withColumn("pos", fn.cell_id(F.col("x"), F.col("y"), F.col("width")))
    return at.join(tiles.select("path", "layer_ord", "pos", "tile_sheet", "tile_index"), ["path", "layer_ord", "pos"], "left").drop("width")


def layers_up_to(layers: DataFrame, name: str = "Buildings") -> DataFrame:
    """Layers up to the last one of a name; none of a map that has no such layer."""
    last = F.max(F.when(F.col("id") == name, F.col("layer_ord"))).over(Window.partitionBy("path"))
    return layers.withColumn("_last", last).where("layer_ord <= _last").drop("_last")


def opaque_tiles(tiles: DataFrame, frames: DataFrame, opaque: DataFrame) -> DataFrame:
    """Tiles with `is_opaque`: by `opaque` (path, tile_sheet, tile_index, is_opaque); an animated tile is where all of its frames are. Unknown ones aren't."""
    key = ["path", "tile_sheet", "tile_index"]
    of_frames = frames.join(opaque, key, "left").groupBy("path", "layer_ord", "pos").agg(F.bool_and(F.coalesce("is_opaque", F.lit(False))).alias("all_frames"))
    known = tiles.join(opaque, key, "left").join(of_frames, ["path", "layer_ord", "pos"], "left")
    return known.withColumn("is_opaque", F.coalesce("all_frames", "is_opaque", F.lit(False))).drop("all_frames")


def without_hidden(tiles: DataFrame) -> DataFrame:
    """Tiles (with is_opaque) without those below the topmost opaque one of their cell."""
    return from_topmost(tiles, ["path", "pos"], F.col("layer_ord"), F.col("is_opaque"))


def warp_target(value: Column) -> Column:
    """The map that a warp command leads to; null for any other text.

    Fixed values: the verbs, and where their target stands. A plain Warp names it first, or behind its coordinates.
    """
    words = F.split(value, " ")

    def word(i: int) -> Column:
        return F.get(words, F.lit(i))

    behind = word(0).isin("WarpWomensLocker", "WarpMensLocker", "LockedDoorWarp")
    plain = F.when(word(1).try_cast("int").isNull(), word(1)).otherwise(word(3))
    return F.when(behind, word(3)).when(word(0) == "Warp", plain).when(word(0) == "MagicWarp", word(1))


def consolidated_cells(tiles: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name, pos, parts, combo) of every cell of the layers drawn under one name: its tiles from the bottom up as one text, and the number
    of that text among the map's, in the order of first use; null where one tile lies alone and stays as it is.
    """
    own = tiles.join(names.select("path", "layer_ord", "name"), ["path", "layer_ord"])
    stack = F.array_sort(F.collect_list(F.struct("layer_ord", "tile_sheet", "tile_index")))
    cells = own.groupBy("path", "name", "pos").agg(F.count("*").alias("n"), F.min("layer_ord").alias("low"), F.array_join(F.transform(stack, lambda t: F.concat_ws("_", t["tile_sheet"], t["tile_index"].cast("string"))), "_").alias("parts"))
    first = cells.where("n > 1").groupBy("path", "parts").agg(F.min(F.struct("low", "name", "pos")).alias("first"))
    numbered = first.withColumn("combo", F.row_number().over(Window.partitionBy("path").orderBy("first")) - 1).select("path", "parts", "combo")
    joined = cells.join(numbered, ["path", "parts"], "left")
    return joined.select("path", "name", "pos", "parts", F.when(F.col("n") > 1, F.col("combo")).alias("combo"))


def placed_lights(value: Column, width: int) -> Column:
    """Tuples of a property's tokens as they are: array<array<string>> of `width` each."""
    return fn.tuples(F.split(value, " "), width)


def light_values(day: DataFrame, night: DataFrame, light: DataFrame, layers: DataFrame, tiles: DataFrame) -> DataFrame:
    """(path, day_tiles, night_tiles, lights): the light properties of a map carried to every tile that looks like one they name.

    day and night: (path, ord, name, x, y, index), light: (path, ord, x, y, level). Cells without a tile count as bad and take no light. Of
    the pairs of day and night index with a sheet the first counts; the tiles of that sheet and day index take it, by the first pair that fits.
    Lights without such a pair stay where they are, behind the others. Layers need `name` and `width`; all lists are in the order of their places.
    """
    days = layer_cells(day, layers, tiles).select("path", "x", "y", F.col("ord").alias("day_ord"), F.when(F.col("tile_sheet").isNotNull(), F.col("index")).alias("day_id"), F.col("tile_sheet").alias("day_sheet"))
    nights = layer_cells(night, layers, tiles).select("path", "x", "y", F.col("ord").alias("night_ord"), F.when(F.col("tile_sheet").isNotNull(), F.col("index")).alias("night_id"), F.col("tile_sheet").alias("night_sheet"))
    bad = days.where("day_sheet IS NULL").select("path", "x", "y").union(nights.where("night_sheet IS NULL").select("path", "x", "y")).distinct()
    both = days.where("day_sheet IS NOT NULL").join(nights.where("night_sheet IS NOT NULL"), ["path", "x", "y"], "full_outer")
    every = both.join(light.join(bad, ["path", "x", "y"], "left_anti").withColumnRenamed("ord", "light_ord"), ["path", "x", "y"], "full_outer")
    every = every.withColumn("sheet", F.coalesce("night_sheet", "day_sheet")).withColumn("at", F.struct(F.coalesce("day_ord", F.lit(1 << 30)), F.coalesce("night_ord", F.lit(1 << 30)), F.coalesce("light_ord", F.lit(1 << 30))))
    pairs = first_of(every.where("day_id IS NOT NULL AND night_id IS NOT NULL"), ["path", "day_id", "night_id"], ["at"])
    alone = every.where("(day_id IS NULL OR night_id IS NULL) AND level IS NOT NULL").select("path", "at", F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.col("level").cast("string")).alias("text"))
    fit = first_of(pairs, ["path", "sheet", "day_id"], ["at"]).select("path", F.col("sheet").alias("tile_sheet"), F.col("day_id").alias("tile_index"), "night_id", "level", "at")
    cells = tiles.join(layers.select("path", "layer_ord", "name", "width"), ["path", "layer_ord"]).join(fit, ["path", "tile_sheet", "tile_index"])
    cells = cells.withColumns({"x": F.col("pos") % F.col("width"), "y": F.floor(F.col("pos") / F.col("width"))})
    place = F.struct("at", "layer_ord", "pos")

    def listed(rows: DataFrame, name: str, *parts: str) -> DataFrame:
        text = F.concat_ws(" ", *(F.col(p).cast("string") for p in parts))
        return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda s: s["text"]), " ").alias(name))

    cells = cells.withColumn("place", place)
    shown = first_of(cells.where("level IS NOT NULL"), ["path", "x", "y"], ["place"])
    lit = listed(shown, "spread", "x", "y", "level")
    stay = alone.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ").alias("stay"))
    out = listed(cells, "day_tiles", "name", "x", "y", "tile_index").join(listed(cells, "night_tiles", "name", "x", "y", "night_id"), "path", "full_outer")
    return out.join(lit, "path", "full_outer").join(stay, "path", "full_outer").select("path", "day_tiles", "night_tiles", F.concat_ws(" ", "spread", "stay").alias("lights"))
