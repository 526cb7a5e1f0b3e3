"""Queries of the map transforms and of the smaller functions, over maps made of the driver tables; each beside SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import maps
from ..operators import relational as rel
from .kernels import table
from .registry import query

#: Tiles of ten maps of seven layers and 200 cells, twenty to a row: one line item each.
TILES = """SELECT path, layer_ord, pos, tile_sheet, tile_index FROM (SELECT CAST(l_suppkey % 10 AS INT) AS path, CAST(l_linenumber AS INT) AS layer_ord, CAST(l_orderkey % 200 AS INT) AS pos,
l_returnflag AS tile_sheet, CAST(l_partkey % 50 AS INT) AS tile_index, row_number() OVER (PARTITION BY l_suppkey % 10, l_linenumber, l_orderkey % 200 ORDER BY l_orderkey, l_partkey, l_suppkey) AS r
FROM {lineitem}) t WHERE r = 1"""
SQL_TILES = TILES.format(lineitem="lineitem")
IDS = ("Back", "Back", "Buildings", "Buildings", "Front", "Paths", "AlwaysFront")
SQL_LAYERS = "SELECT CAST(p AS INT) AS path, CAST(o AS INT) AS layer_ord, ['Back', 'Back', 'Buildings', 'Buildings', 'Front', 'Paths', 'AlwaysFront'][o] AS id FROM range(10) a(p), range(1, 8) b(o)"
FRAMES = "SELECT path, layer_ord, pos, CAST(k AS INT) AS frame_ord, tile_sheet, (tile_index + 7 * CAST(k AS INT)) % 50 AS tile_index FROM t, (SELECT unnest(range(3)) AS k) f WHERE tile_index % 5 = 0"


def tiles_of(spark, sf_dir):
    return spark.sql(TILES.format(lineitem="{items}"), items=table(spark, sf_dir, "lineitem"))


def layers_of(spark):
    ids = F.array(*map(F.lit, IDS))
    each = spark.range(70).select((F.col("id") % 10).cast("int").alias("path"), (F.floor(F.col("id") / 10) + 1).cast("int").alias("layer_ord"))
    return each.withColumns({"id": F.element_at(ids, F.col("layer_ord")), "width": F.lit(20)})


def frames_of(tiles):
    each = tiles.where("tile_index % 5 = 0").withColumn("frame_ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return each.withColumn("tile_index", (F.col("tile_index") + 7 * F.col("frame_ord")) % 50)


PROPERTIES = "SELECT event_id, event_type AS key, CAST(event_id % 4 AS INT) AS type, CASE WHEN event_id % 4 = 3 THEN CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN 'Custom_' || event_type END END AS value_string FROM events"


def properties_of(spark, sf_dir):
    kind = F.expr("element_at(array('map', 'tile', 'sheet', 'layer'), CAST(event_id % 7 % 4 AS INT) + 1)")
    return spark.sql(PROPERTIES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).withColumn("owner_kind", kind)


@query("map_empty_strings", f"WITH p AS ({PROPERTIES}) SELECT event_id, key, value_string FROM p WHERE NOT coalesce(type = 3 AND value_string = '', false)")
def map_empty_strings(spark, sf_dir):
    """Properties of an empty string go, nulls stay."""
    return maps.without_empty_strings(properties_of(spark, sf_dir)).select("event_id", "key", "value_string")


@query("map_custom_strings", f"WITH p AS ({PROPERTIES}) SELECT event_id, CASE WHEN type = 3 AND event_id % 7 % 4 < 2 THEN replace(value_string, 'Custom_', '') ELSE value_string END AS value_string FROM p")
def map_custom_strings(spark, sf_dir):
    """Custom_ goes from strings of maps and tiles."""
    return maps.without_prefix(properties_of(spark, sf_dir)).select("event_id", "value_string")


@query("map_bare_images", "SELECT p_partkey, p_brand || '/' || p_type AS image FROM part")
def map_bare_images(spark, sf_dir):
    """Images of sheets without .png, wherever it stands."""
    sheets = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(".png/"), "p_type", F.lit(".png")).alias("image"))
    return maps.bare_images(sheets)


@query("map_first_property", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_returnflag = 'R') AS value FROM lineitem GROUP BY 1")
def map_first_property(spark, sf_dir):
    """The first property of a key."""
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("value"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed.alias("props")).select("l_orderkey", maps.first_property(F.col("props"), "R").alias("value"))


DRAWN = f"SELECT path, layer_ord, id, CASE WHEN (path + layer_ord) % 3 = 0 THEN 'Draw_' || CAST(layer_ord % 2 AS VARCHAR) ELSE id END AS name FROM ({SQL_LAYERS}) l"


def drawn_layers(spark):
    layers = layers_of(spark)
    drawn = layers.where("(path + layer_ord) % 3 = 0")
    props = drawn.select("path", "layer_ord", F.lit("layer").alias("owner_kind"), F.lit("Draw").alias("key"), F.lit(1).alias("prop_ord"), F.concat(F.lit("Draw_"), (F.col("layer_ord") % 2).cast("string")).alias("value_string"))
    props = props.unionByName(drawn.select("path", "layer_ord", F.lit("layer").alias("owner_kind"), F.lit("Draw").alias("key"), F.lit(2).alias("prop_ord"), F.lit("later").alias("value_string")))
    return maps.layer_names(layers, props)


@query("map_layer_groups", f"WITH l AS ({DRAWN}) SELECT path, name, count(*) AS n, string_agg(CAST(layer_ord AS VARCHAR), ',' ORDER BY layer_ord) AS layers FROM l GROUP BY 1, 2")
def map_layer_groups(spark, sf_dir):
    """Layers by the name they are drawn under."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("layer_ord")), lambda o: o.cast("string")), ",")
    return drawn_layers(spark).groupBy("path", "name").agg(F.count("*").alias("n"), listed.alias("layers"))


def sheet_properties(spark, sf_dir):
    """Properties of tiles on three sheets: every second part one, keyed @TileIndex@index@number."""
    sheets = spark.createDataFrame([(p, o, s) for p in range(10) for o, s in enumerate("ANR")], "path int, sheet_ord int, id string")
    parts = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("CAST(p_partkey % 10 AS INT) AS path", "CAST(p_partkey % 3 AS INT) AS sheet_ord", "concat('@TileIndex@', p_partkey % 50, '@', p_partkey) AS key", "p_partkey AS prop_ord", "'sheet' AS owner_kind")
    return sheets, maps.sheet_tile_properties(sheets, parts)


SQL_SHEET_PROPS = "SELECT CAST(p_partkey % 10 AS INT) AS path, ['A', 'N', 'R'][p_partkey % 3 + 1] || '@' || CAST(p_partkey % 50 AS VARCHAR) AS tile_key, p_partkey AS prop_ord, '@TileIndex@' || CAST(p_partkey % 50 AS VARCHAR) || '@' || CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 2 = 0"


@query("map_sheet_properties", f"WITH s AS ({SQL_SHEET_PROPS}) SELECT path, tile_key, count(*) AS n, min(key) AS least FROM s GROUP BY 1, 2")
def map_sheet_properties(spark, sf_dir):
    """Properties of sheets by the tile they belong to."""
    return sheet_properties(spark, sf_dir)[1].groupBy("path", "tile_key").agg(F.count("*").alias("n"), F.min("key").alias("least"))


SQL_USED = f"WITH t AS ({SQL_TILES}), f AS ({FRAMES}) SELECT DISTINCT path, tile_sheet, tile_index FROM (SELECT path, tile_sheet, tile_index FROM t UNION ALL SELECT path, tile_sheet, tile_index FROM f) u"


@query("map_used_tiles", SQL_USED)
def map_used_tiles(spark, sf_dir):
    """Tiles in use, alone or as frames."""
    tiles = tiles_of(spark, sf_dir)
    return maps.used_tiles(tiles, frames_of(tiles))


@query("map_used_properties", f"WITH s AS ({SQL_SHEET_PROPS}), u AS ({SQL_USED}) SELECT path, tile_key, prop_ord FROM s WHERE (path, tile_key) IN (SELECT path, tile_sheet || '@' || CAST(tile_index AS VARCHAR) FROM u WHERE path < 5)")
def map_used_properties(spark, sf_dir):
    """Properties of sheets whose tile is in use."""
    tiles = tiles_of(spark, sf_dir).where("path < 5")
    return maps.used_properties(sheet_properties(spark, sf_dir)[1], maps.used_tiles(tiles, frames_of(tiles))).select("path", "tile_key", "prop_ord")


@query("map_tile_properties", f"WITH t AS ({SQL_TILES}), s AS ({SQL_SHEET_PROPS}), g AS (SELECT path, tile_key, string_agg(key, ' ' ORDER BY prop_ord) AS keys FROM s GROUP BY 1, 2) SELECT t.path, layer_ord, pos, coalesce(keys, '') AS keys FROM t LEFT JOIN g ON g.path = t.path AND tile_key = tile_sheet || '@' || CAST(tile_index AS VARCHAR)")
def map_tile_properties(spark, sf_dir):
    """Tiles with the properties of their place on the sheet."""
    found = maps.with_tile_properties(tiles_of(spark, sf_dir), sheet_properties(spark, sf_dir)[1])
    return found.select("path", "layer_ord", "pos", F.array_join("keys", " ").alias("keys"))


@query("map_merged_sheets", f"WITH t AS ({SQL_TILES}) SELECT path, layer_ord, pos, CASE WHEN tile_sheet = 'R' THEN 'A' ELSE tile_sheet END AS tile_sheet FROM t")
def map_merged_sheets(spark, sf_dir):
    """Sheets of one image merged, and tiles moved to the one that stays."""
    rows = [(p, o, s, i) for p in range(10) for o, (s, i) in enumerate((("A", "town.png"), ("N", "wood.png"), ("R", "town.png")))]
    sheets = maps.merged_sheets(spark.createDataFrame(rows, "path int, sheet_ord int, id string, image string"))
    return maps.remapped(tiles_of(spark, sf_dir), sheets).select("path", "layer_ord", "pos", "tile_sheet")


SQL_WANTED = "SELECT CAST(c_custkey % 10 AS INT) AS path, ['Back', 'Buildings', 'Front', 'Nowhere'][c_nationkey % 4 + 1] AS name, CAST(c_custkey % 20 AS INT) AS x, CAST(c_custkey // 20 % 10 AS INT) AS y, c_custkey FROM customer"


@query("map_layer_cells", f"""WITH t AS ({SQL_TILES}), w AS ({SQL_WANTED}), l AS (SELECT path, id, min(layer_ord) AS layer_ord FROM ({SQL_LAYERS}) x GROUP BY 1, 2)
SELECT c_custkey, tile_sheet, tile_index FROM w JOIN l ON w.path = l.path AND w.name = l.id LEFT JOIN t ON t.path = w.path AND t.layer_ord = l.layer_ord AND t.pos = y * 20 + x""")
def map_layer_cells(spark, sf_dir):
    """Cells by layer name and place; of layers with one name the first."""
    wanted = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey % 10 AS INT) AS path", "element_at(array('Back', 'Buildings', 'Front', 'Nowhere'), c_nationkey % 4 + 1) AS name", "CAST(c_custkey % 20 AS INT) AS x", "CAST(floor(c_custkey / 20) % 10 AS INT) AS y", "c_custkey"
    )
    return maps.layer_cells(wanted, layers_of(spark).withColumnRenamed("id", "name"), tiles_of(spark, sf_dir)).select("c_custkey", "tile_sheet", "tile_index")


@query("map_layers_up_to", "SELECT CAST(p AS INT) AS path, CAST(o AS INT) AS layer_ord FROM range(10) a(p), range(1, 5) b(o)")
def map_layers_up_to(spark, sf_dir):
    """Layers from the bottom to the last Buildings."""
    return maps.layers_up_to(layers_of(spark)).select("path", "layer_ord")


SQL_OPAQUE = f"""t AS ({SQL_TILES}), f AS ({FRAMES}), o AS (SELECT t.path, t.layer_ord, t.pos, CASE WHEN t.tile_index % 5 = 0 THEN (SELECT bool_and(f.tile_index % 3 <> 0) FROM f WHERE f.path = t.path AND f.layer_ord = t.layer_ord AND f.pos = t.pos)
ELSE t.tile_index % 3 <> 0 END AS is_opaque FROM t)"""


@query("map_hidden_tiles", f"WITH {SQL_OPAQUE}, m AS (SELECT *, max(CASE WHEN is_opaque THEN layer_ord END) OVER (PARTITION BY path, pos) AS top FROM o) SELECT path, layer_ord, pos, is_opaque FROM m WHERE top IS NULL OR layer_ord >= top")
def map_hidden_tiles(spark, sf_dir):
    """Tiles below the topmost opaque one go; an animated tile is opaque where all of its frames are."""
    tiles = tiles_of(spark, sf_dir)
    frames = frames_of(tiles)
    images = maps.used_tiles(tiles, frames).withColumn("is_opaque", F.col("tile_index") % 3 != 0)
    still = tiles.withColumn("shown", F.col("tile_index"))
    return maps.without_hidden(maps.opaque_tiles(still, frames, images)).select("path", "layer_ord", "pos", "is_opaque")


@query("map_consolidated", f"""WITH t AS ({SQL_TILES}), l AS ({DRAWN}), c AS (SELECT t.path, name, pos, count(*) AS n, min(t.layer_ord) AS low, string_agg(tile_sheet || '_' || CAST(tile_index AS VARCHAR), '_' ORDER BY t.layer_ord) AS parts
FROM t JOIN l ON l.path = t.path AND l.layer_ord = t.layer_ord GROUP BY 1, 2, 3), f AS (SELECT path, parts, min((low, name, pos)) AS first FROM c WHERE n > 1 GROUP BY 1, 2),
k AS (SELECT path, parts, CAST(row_number() OVER (PARTITION BY path ORDER BY first) - 1 AS INT) AS combo FROM f) SELECT c.path, name, pos, c.parts, CASE WHEN n > 1 THEN combo END AS combo FROM c LEFT JOIN k ON k.path = c.path AND k.parts = c.parts""")
def map_consolidated(spark, sf_dir):
    """Layers drawn under one name laid over one another: each different stack of tiles takes a number."""
    return maps.consolidated_cells(tiles_of(spark, sf_dir), drawn_layers(spark))


WARPS = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Warp 3 4 ' || o_orderstatus WHEN 1 THEN 'Warp ' || o_orderstatus || ' 5' WHEN 2 THEN 'MagicWarp ' || o_orderstatus || ' 1 2' WHEN 3 THEN 'LockedDoorWarp 1 2 ' || o_orderstatus WHEN 4 THEN 'Warp' ELSE 'Message ' || o_orderstatus END AS value FROM orders"


@query("map_warps", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN o_orderstatus END AS target FROM orders")
def map_warps(spark, sf_dir):
    """Targets of warp commands."""
    return spark.sql(WARPS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")).select("o_orderkey", maps.warp_target(F.col("value")).alias("target"))


LIGHT_SQL = f"""WITH t AS ({SQL_TILES}), src AS (SELECT CAST(s_suppkey % 10 AS INT) AS path, s_suppkey AS ord, CAST(s_suppkey * 7 % 20 AS INT) AS x, CAST(s_suppkey * 3 % 10 AS INT) AS y, CAST(s_suppkey % 9 AS INT) AS v FROM supplier WHERE s_suppkey <= 60),
u AS (SELECT *, row_number() OVER (PARTITION BY path, x, y ORDER BY ord) AS r FROM src), s AS (SELECT path, ord, x, y, v FROM u WHERE r = 1),
c AS (SELECT s.*, tile_sheet, t.path IS NULL AS bad FROM s LEFT JOIN t ON t.path = s.path AND t.layer_ord = 1 AND t.pos = y * 20 + x),
p AS (SELECT *, row_number() OVER (PARTITION BY path, v, v + 10 ORDER BY ord) AS r1 FROM c WHERE NOT bad AND ord % 3 <> 0), q AS (SELECT *, row_number() OVER (PARTITION BY path, tile_sheet, v ORDER BY ord) AS r2 FROM p WHERE r1 = 1),
k AS (SELECT t.path, t.layer_ord, t.pos, t.pos % 20 AS x, t.pos // 20 AS y, t.tile_index, q.ord, q.v + 10 AS night FROM t JOIN q ON r2 = 1 AND q.path = t.path AND q.tile_sheet = t.tile_sheet AND q.v = t.tile_index WHERE t.layer_ord IN (1, 3))
SELECT path, string_agg(CASE layer_ord WHEN 1 THEN 'Back' ELSE 'Buildings' END || ' ' || x || ' ' || y || ' ' || tile_index, ' ' ORDER BY ord, layer_ord, pos) AS day_tiles,
string_agg(CASE layer_ord WHEN 1 THEN 'Back' ELSE 'Buildings' END || ' ' || x || ' ' || y || ' ' || night, ' ' ORDER BY ord, layer_ord, pos) AS night_tiles FROM k GROUP BY 1"""


@query("map_lights", LIGHT_SQL)
def map_lights(spark, sf_dir):
    """Day and night tiles carried to every tile that looks like one they name."""
    src = table(spark, sf_dir, "supplier").where("s_suppkey <= 60").selectExpr("CAST(s_suppkey % 10 AS INT) AS path", "s_suppkey AS ord", "CAST(s_suppkey * 7 % 20 AS INT) AS x", "CAST(s_suppkey * 3 % 10 AS INT) AS y", "CAST(s_suppkey % 9 AS INT) AS v")
    cells = rel.first_of(src, ["path", "x", "y"], ["ord"]).withColumn("name", F.lit("Back"))
    day = cells.where("ord % 3 <> 0").withColumn("index", F.col("v"))
    night = cells.where("ord % 3 <> 0").withColumn("index", F.col("v") + 10)
    layers = layers_of(spark).where("layer_ord IN (1, 3)").withColumnRenamed("id", "name")
    light = cells.where("ord % 2 = 0").select("path", "ord", "x", "y", F.col("v").alias("level"))
    found = maps.light_values(day.drop("v"), night.drop("v"), light, layers, tiles_of(spark, sf_dir))
    return found.where("day_tiles IS NOT NULL").select("path", "day_tiles", "night_tiles")


# --- functions ----------------------------------------------------------------------------------------


@query("codec_names", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pcm' WHEN 1 THEN 'xma' WHEN 2 THEN 'adpcm' WHEN 3 THEN 'wma' ELSE 'unknown' END AS codec, CASE WHEN event_id % 5 < 3 THEN '.wav' WHEN event_id % 5 = 3 THEN '.wma' ELSE '.bin' END AS ext, event_id % 20 = 1 AS effect, event_id % 20 IN (1, 2) AS bank, event_id % 20 IN (1, 2, 3, 17) AS any_use FROM events")
def codec_names(spark, sf_dir):
    """Names and extensions of codecs, and the format tags that each use allows."""
    codec, tag = F.col("event_id") % 5, F.col("event_id") % 20
    return table(spark, sf_dir, "events").select("event_id", fn.codec_name(codec).alias("codec"), fn.codec_extension(codec).alias("ext"), fn.codec_allowed(tag, "SoundEffect").alias("effect"), fn.codec_allowed(tag, "Xact").alias("bank"), fn.codec_allowed(tag, "All").alias("any_use"))


@query("texture_bytes", "SELECT p_partkey, CAST(ceil(p_size / 4.0) * ceil(p_partkey % 33 / 4.0) * 8 AS BIGINT) AS dxt1, CAST(ceil(p_size / 4.0) * ceil(p_partkey % 33 / 4.0) * 16 AS BIGINT) AS dxt5 FROM part")
def texture_bytes(spark, sf_dir):
    """Bytes of block-coded textures."""
    w, h = F.col("p_size"), F.col("p_partkey") % 33
    return table(spark, sf_dir, "part").select("p_partkey", fn.dxt_bytes(w, h, 8).alias("dxt1"), fn.dxt_bytes(w, h, 16).alias("dxt5"))


@query("event_bits", "SELECT o_orderkey, (o_custkey >> 2) & 1 = 1 AS simple, (o_custkey >> 3) & 7 AS variation, o_custkey & 31 AS event, CAST((1 << CAST(o_orderkey % 9 AS INT)) - 1 AS BIGINT) AS mask FROM orders")
def event_bits(spark, sf_dir):
    """Flag bits of cues, variations and events, and speaker masks."""
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.cue_is_simple(c).alias("simple"), fn.variation_type(c).cast("long").alias("variation"), fn.event_id(c).cast("long").alias("event"), fn.variable_mask(F.col("o_orderkey") % 9).alias("mask"))


@query("path_helpers", r"SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, regexp_replace(url, '\.[^./]*$', '') || '.json' AS renamed FROM pages")
def path_helpers(spark, sf_dir):
    """Parents, stems and changed extensions of paths."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fn.parent(url).alias("parent"), fn.stem(url).alias("stem"), fn.change_extension(url, ".json").alias("renamed"))


@query("epoch_texts", "SELECT event_id, strftime(make_timestamp(event_id * 86461000 * 1000), '%Y/%-m/%-d %-H:%-M') AS text FROM events")
def epoch_texts(spark, sf_dir):
    """Milliseconds since the epoch as dates."""
    return table(spark, sf_dir, "events").select("event_id", fn.epoch_text(F.col("event_id") * 86461000).alias("text"))


@query("joined_texts", "SELECT r_regionkey, concat_ws(' | ', r_name, CAST(r_regionkey AS VARCHAR)) AS text, substring(sha256(r_name), 1, 16) AS unique_name, r_name || '@' || r_regionkey AS tile_key FROM region")
def joined_texts(spark, sf_dir):
    """Values joined, names by content, and tile keys."""
    return table(spark, sf_dir, "region").select("r_regionkey", fn.joined(F.array("r_name", F.lit(None).cast("string"), F.col("r_regionkey").cast("string")), " | ").alias("text"), fn.unique_name(F.col("r_name")).alias("unique_name"), fn.tile_key(F.col("r_name"), F.col("r_regionkey")).alias("tile_key"))


@query("vector_algebra", "SELECT p_partkey, CAST(p_size * 3 + 2 * (p_partkey % 7) AS DOUBLE) AS dot, CAST(p_size + p_partkey % 7 AS DOUBLE) AS first_sum, CAST(2 - 3 AS DOUBLE) AS second_difference, least(greatest(CAST(p_size AS DOUBLE), 5), 20) AS clamped, p_size < 3 AS any_less, CAST(p_size AS DOUBLE) / 3 AS first_quotient, CAST(p_size * 4 AS DOUBLE) AS scaled, floor(p_size / 2.0 + 0.5) AS half FROM part")
def vector_algebra(spark, sf_dir):
    """Sums, products, quotients, bounds and comparisons of vectors."""
    a, b = F.array(F.col("p_size").cast("double"), F.lit(2.0)), F.array(F.lit(3.0), (F.col("p_partkey") % 7).cast("double"))
    c = F.array((F.col("p_partkey") % 7).cast("double"), F.lit(3.0))
    first = lambda v: F.get(v, F.lit(0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.dot(a, b).alias("dot"), first(fn.vector_add(a, c)).alias("first_sum"), F.get(fn.vector_subtract(a, c), F.lit(1)).alias("second_difference"), first(fn.clamp(a, 5.0, 20.0)).alias("clamped"),
        fn.any_less(F.array(F.col("p_size").cast("double")), F.array(F.lit(3.0))).alias("any_less"), first(fn.vector_divide(a, b)).alias("first_quotient"), first(fn.vector_scale(a, 4)).alias("scaled"), first(fn.vector_half(fn.vector_scale(a, 0.5))).alias("half"),
    )


@query("reverb_names", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS reflections_delay_ms, CAST(embedding[9] AS DOUBLE) AS low_eq_gain, CAST(embedding[22] AS DOUBLE) AS wet_dry_mix_pct FROM embeddings")
def reverb_names(spark, sf_dir):
    """Parameters of reverbs by name."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", fn.reverb(F.col("embedding")).alias("r"))
    return rows.select("vec_id", *[F.col(f"r.{c}").cast("double").alias(c) for c in ("reflections_delay_ms", "low_eq_gain", "wet_dry_mix_pct")])


@query("edge_tuples", "SELECT p_partkey, lcm(p_partkey % 3, CAST(p_size AS BIGINT)) AS l, CASE WHEN p_size % 5 >= 2 THEN p_size % 5 // 2 ELSE 0 END AS pairs, CASE WHEN p_size >= 20 THEN p_size // 20 ELSE 0 END AS ticks FROM part")
def edge_tuples(spark, sf_dir):
    """Multiples of zero, lists shorter than a tuple and animations shorter than a tick."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.lcm(F.array(F.col("p_partkey") % 3, size.cast("long"))).alias("l"), F.size(fn.tuples(F.slice(F.array(*map(F.lit, range(5))), F.lit(1), size % 5), 2)).alias("pairs"), F.size(rel.resample(F.lit(10), F.lit(3), F.lit(20), size)).alias("ticks"),
    )


# --- lists, unions, aggregates ------------------------------------------------------------------------


@query("reversed_lists", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS orders FROM orders GROUP BY 1")
def reversed_lists(spark, sf_dir):
    """Lists the other way round."""
    listed = F.reverse(F.array_sort(F.collect_list("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda o: o.cast("string")), ",").alias("orders"))


@query("stable_projection", "SELECT vec_id // 10 AS block, vec_id, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY floor(CAST(embedding[1] AS DOUBLE) * 4), vec_id) - 1 AS place FROM embeddings")
def stable_projection(spark, sf_dir):
    """Colours of a block in the order of a projection; equal ones keep their order."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("block"), "vec_id", F.floor(F.get("embedding", F.lit(0)).cast("double") * 4).alias("projection"))
    return rel.numbered(rows, ["block"], ["projection", "vec_id"], "_n").select("block", "vec_id", (F.col("_n") - 1).cast("long").alias("place"))


@query("file_batches", "SELECT (row_number() OVER (ORDER BY page_id) - 1) // 15 AS batch, page_id FROM pages")
def file_batches(spark, sf_dir):
    """Batches of fifteen files at most."""
    rows = table(spark, sf_dir, "pages").select("page_id")
    ordered = F.row_number().over(Window.orderBy("page_id")) - 1  # a list of files, not of rows
    return rows.select(fn.batch_of(ordered, 15).alias("batch"), "page_id")


@query("file_union", "SELECT kind, count(*) AS n FROM (SELECT 'xwb' AS kind FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'xgs' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT 'xsb' FROM pages WHERE page_id % 3 = 2) u GROUP BY 1")
def file_union(spark, sf_dir):
    """Three lists of files as one."""
    pages = table(spark, sf_dir, "pages")
    parts = [pages.where(F.col("page_id") % 3 == k).select(F.lit(kind).alias("kind"), "page_id") for k, kind in enumerate(("xwb", "xgs", "xsb"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("keyed_map", "SELECT n_regionkey, count(*) AS n, min(CASE WHEN n_nationkey = 7 THEN n_name END) AS seventh FROM nation GROUP BY 1")
def keyed_map(spark, sf_dir):
    """Lists as maps by key."""
    made = rel.keyed_map(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", "n_name", "names")
    return made.select("n_regionkey", F.size("names").cast("long").alias("n"), F.try_element_at("names", F.lit(7)).alias("seventh"))


@query("matched_fields", "SELECT p_partkey, p_brand FROM part")
def matched_fields(spark, sf_dir):
    """Fields that a target has, by name and type."""
    return rel.matched_fields(table(spark, sf_dir, "part"), {"p_partkey": "bigint", "p_brand": "string"})


@query("curve_variables", "WITH v AS (SELECT p_brand, p_size % 2 = 0 AS is_global, min(p_partkey) AS variable FROM part GROUP BY 1, 2) SELECT p.p_partkey, variable FROM part p LEFT JOIN v ON v.p_brand = p.p_brand AND v.is_global = (p.p_partkey % 2 = 0)")
def curve_variables(spark, sf_dir):
    """Curves to the first variable of their name, within global or cue variables."""
    part = table(spark, sf_dir, "part")
    variables = part.select("p_brand", (F.col("p_size") % 2 == 0).alias("is_global"), F.col("p_partkey").alias("variable"))
    first = variables.groupBy("p_brand", "is_global").agg(F.min("variable").alias("variable"))
    return part.select("p_partkey", "p_brand", (F.col("p_partkey") % 2 == 0).alias("is_global")).join(first, ["p_brand", "is_global"], "left").select("p_partkey", "variable")


@query("variation_weights", "SELECT l_orderkey, CAST(sum(l_linenumber + l_partkey % 9 - l_linenumber) AS BIGINT) AS weight FROM lineitem GROUP BY 1")
def variation_weights(spark, sf_dir):
    """Weights of a variation's tracks together: the widths of their ranges."""
    low, high = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_partkey") % 9
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(high - low).cast("long").alias("weight"))


@query("block_colours", "SELECT l_orderkey, l_partkey % 8 AS colour, count(*) AS n, CAST(sum(l_suppkey % 5 + 1) AS BIGINT) AS weight FROM lineitem WHERE l_linenumber <= 16 GROUP BY 1, 2")
def block_colours(spark, sf_dir):
    """Different colours of a block with their weights."""
    return table(spark, sf_dir, "lineitem").where("l_linenumber <= 16").groupBy("l_orderkey", (F.col("l_partkey") % 8).alias("colour")).agg(F.count("*").alias("n"), F.sum(F.col("l_suppkey") % 5 + 1).cast("long").alias("weight"))


MOMENTS = "WITH p AS (SELECT l_orderkey, l_partkey % 256 AS x, l_suppkey % 256 AS y, l_linenumber AS w FROM lineitem), m AS (SELECT l_orderkey, sum(w * x) * 1.0::DOUBLE / sum(w) AS mx, sum(w * y) * 1.0::DOUBLE / sum(w) AS my FROM p GROUP BY 1) SELECT p.l_orderkey, round(any_value(mx), 6) AS mean_x, round(sum(w * (x - mx) * (x - mx)), 3) AS xx, round(sum(w * (x - mx) * (y - my)), 3) AS xy, round(sum(w * (y - my) * (y - my)), 3) AS yy FROM p JOIN m ON m.l_orderkey = p.l_orderkey GROUP BY 1"


@query("block_moments", MOMENTS)
def block_moments(spark, sf_dir):
    """Weighted mean and covariance of a block's colours."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CAST(l_partkey % 256 AS DOUBLE) AS x", "CAST(l_suppkey % 256 AS DOUBLE) AS y", "CAST(l_linenumber AS DOUBLE) AS w")
    own = Window.partitionBy("l_orderkey")
    mean = lambda c: F.sum(F.col("w") * F.col(c)).over(own) / F.sum("w").over(own)
    off = rows.withColumns({"mx": mean("x"), "my": mean("y")})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return off.groupBy("l_orderkey").agg(F.round(F.first("mx"), 6).alias("mean_x"), F.round(F.sum(F.col("w") * dx * dx), 3).alias("xx"), F.round(F.sum(F.col("w") * dx * dy), 3).alias("xy"), F.round(F.sum(F.col("w") * dy * dy), 3).alias("yy"))


@query("alpha_ranges", "SELECT l_orderkey, min(a) AS low, max(a) AS high, min(a) FILTER (a NOT IN (0, 255)) AS inner_low, max(a) FILTER (a NOT IN (0, 255)) AS inner_high FROM (SELECT l_orderkey, l_partkey % 4 * 85 AS a FROM lineitem) p GROUP BY 1")
def alpha_ranges(spark, sf_dir):
    """Least and greatest alpha of a block, with and without the two extremes."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4 * 85).alias("a"))
    inner = F.when(~F.col("a").isin(0, 255), F.col("a"))
    return rows.groupBy("l_orderkey").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.min(inner).alias("inner_low"), F.max(inner).alias("inner_high"))


@query("all_frames", "SELECT l_orderkey, bool_and(l_quantity >= 5) AS whole FROM lineitem GROUP BY 1")
def all_frames(spark, sf_dir):
    """Whether all frames of an animation pass."""
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return listed.select("l_orderkey", F.forall("q", lambda q: q >= 5).alias("whole"))


@query("sheet_places", "SELECT p_partkey, CAST(ceil(sqrt(p_size)) AS BIGINT) AS side, (p_partkey % p_size) % CAST(ceil(sqrt(p_size)) AS BIGINT) * 16 AS left_px, (p_partkey % p_size) // CAST(ceil(sqrt(p_size)) AS BIGINT) * 16 AS top_px FROM part")
def sheet_places(spark, sf_dir):
    """Places of tiles on the smallest square sheet that holds them."""
    side = fn.sheet_side(F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", side.alias("side"), (F.col("p_partkey") % F.col("p_size")).alias("k"))
    return rows.withColumn("r", fn.tile_rect(F.col("k"), F.col("side"))).select("p_partkey", "side", F.col("r.left").alias("left_px"), F.col("r.top").alias("top_px"))


@query("dispatched", "SELECT CASE WHEN ext = '.config' THEN 'pack' WHEN ext IN ('.xnb', '.tbin') THEN 'unpack' WHEN ext IN ('.xwb', '.xgs', '.xsb') THEN 'audio' ELSE 'none' END AS mode, count(*) AS n FROM (SELECT ['.config', '.xnb', '.tbin', '.xwb', '.xgs', '.xsb', '.txt'][page_id % 7 + 1] AS ext FROM pages) f GROUP BY 1")
def dispatched(spark, sf_dir):
    """What is done with a file, by its extension."""
    ext = F.element_at(F.array(*map(F.lit, (".config", ".xnb", ".tbin", ".xwb", ".xgs", ".xsb", ".txt"))), (F.col("page_id") % 7 + 1).cast("int"))
    mode = F.when(ext == ".config", "pack").when(ext.isin(".xnb", ".tbin"), "unpack").when(ext.isin(".xwb", ".xgs", ".xsb"), "audio").otherwise("none")
    return table(spark, sf_dir, "pages").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))
