"""Queries that run the asset kernels over the driver tables, each beside SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import relational as rel
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HASHED = "(l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber) & 4294967295"


@query(
    "files_by_ext",
    """SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CAST(len(string_split(regexp_replace(url, '[?#].*$', ''), '/')) - 3 AS BIGINT) AS depth,
       regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^./]*)$', 1) AS ext, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1, 2, 3""",
)
def files_by_ext(spark, sf_dir):
    """File discovery: files by extension, folder depth and root."""
    path = F.regexp_replace("url", "[?#].*$", "")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    depth = (F.size(F.split(path, "/")) - 3).cast("long")
    return table(spark, sf_dir, "pages").groupBy(host.alias("host"), depth.alias("depth"), fn.extension(path).alias("ext")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(
    "magic_validate",
    """SELECT CASE WHEN NOT starts_with(url, 'https://') THEN 'bad_magic' WHEN length(html) <= 4096 THEN 'short' ELSE 'ok' END AS state, count(*) AS n,
       CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1""",
)
def magic_validate(spark, sf_dir):
    """Header checks give a state for each file, never an exception."""
    state = F.when(~F.col("url").startswith("https://"), "bad_magic").when(F.length("html") <= 4096, "short").otherwise("ok")
    return table(spark, sf_dir, "pages").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.length("html")).cast("long").alias("chars"))


@query(
    "header_bitfields",
    f"""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {HASHED} AS f, 1 + l_linenumber * 7 % 45 AS v FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v <= 3 AND (CASE WHEN v = 1 THEN f & 1 ELSE f & 3 END) = 1 THEN 2 WHEN v = 1 THEN f & 1 ELSE f & 3 END AS codec,
       CASE WHEN v = 1 THEN (f >> 1) & 7 ELSE (f >> 2) & 7 END AS channels, (f >> 5) & 262143 AS rate, (f >> 23) & 255 AS align, (f >> 31) & 1 AS bits FROM h""",
)
def header_bitfields(spark, sf_dir):
    """Wave format words, of either layout, to fields."""
    rows = table(spark, sf_dir, "lineitem").withColumn("f", F.expr(HASHED)).withColumn("v", F.expr("1 + l_linenumber * 7 % 45"))
    rows = rows.withColumn("w", fn.wave_format(F.col("f"), F.col("v")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "w.codec", "w.channels", "w.rate", "w.align", "w.bits")


@query(
    "category_flags",
    """SELECT (o_custkey & 7) AS fade_type, (o_custkey & 255) >> 3 AS behavior, (o_orderkey & 1) = 1 AS is_music, ((o_orderkey >> 1) & 1) = 1 AS is_public, count(*) AS n
       FROM orders GROUP BY 1, 2, 3, 4""",
)
def category_flags(spark, sf_dir):
    """Flag bytes of sound categories, counted by what they say."""
    rows = table(spark, sf_dir, "orders").select(fn.category_flags(F.col("o_custkey").bitwiseAND(F.lit(255))).alias("c"), fn.visibility_flags(F.col("o_orderkey")).alias("v"))
    return rows.groupBy("c.fade_type", "c.behavior", "v.is_music", "v.is_public").agg(F.count("*").alias("n"))


@query(
    "rgb565_roundtrip",
    """WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 59) % 256 AS g, (p_partkey * 83) % 256 AS b FROM part),
       k AS (SELECT *, CAST(floor(r * 31 / 255.0::DOUBLE + 0.5) AS BIGINT) * 2048 + CAST(floor(g * 63 / 255.0::DOUBLE + 0.5) AS BIGINT) * 32 + CAST(floor(b * 31 / 255.0::DOUBLE + 0.5) AS BIGINT) AS packed FROM c)
       SELECT p_partkey, packed, ((packed >> 11) & 31) * 8 + (((packed >> 11) & 31) >> 2) AS red, ((packed >> 5) & 63) * 4 + (((packed >> 5) & 63) >> 4) AS green,
       (packed & 31) * 8 + ((packed & 31) >> 2) AS blue FROM k""",
)
def rgb565_roundtrip(spark, sf_dir):
    """Colours to 16 bits and back."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", fn.pack_rgb565(key * 37 % 256, key * 59 % 256, key * 83 % 256).alias("packed"))
    return rows.withColumn("c", fn.unpack_rgb565(F.col("packed"))).select("p_partkey", "packed", "c.red", "c.green", "c.blue")


@query(
    "alpha_premultiply",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 256 AS a, (l_orderkey * 7 + l_linenumber) % 256 AS c FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c * a // 255 AS stored,
       CASE WHEN a = 0 THEN CASE WHEN c * a // 255 = 0 THEN 0 ELSE 255 END ELSE least(((c * a // 255) * 255 + a - 1) // a, 255) END AS restored FROM c""",
)
def alpha_premultiply(spark, sf_dir):
    """Colour channels multiplied by alpha, and what can be restored."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("l_partkey % 256").alias("a"), F.expr("(l_orderkey * 7 + l_linenumber) % 256").alias("c"))
    rows = rows.withColumn("stored", fn.premultiply(F.col("c"), F.col("a")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "stored", fn.unpremultiply(F.col("stored"), F.col("a")).alias("restored"))


@query(
    "varint_length",
    """SELECT CASE WHEN k < 128 THEN 1 WHEN k < 16384 THEN 2 WHEN k < 2097152 THEN 3 WHEN k < 268435456 THEN 4 ELSE 5 END AS bytes, count(*) AS n FROM (SELECT o_orderkey * 97 AS k FROM orders) GROUP BY 1""",
)
def varint_length(spark, sf_dir):
    """Bytes that keys take in 7-bit groups."""
    return table(spark, sf_dir, "orders").groupBy(fn.varint_size(F.col("o_orderkey") * 97).alias("bytes")).agg(F.count("*").alias("n"))


@query(
    "wav_header_math",
    """WITH w AS (SELECT event_id, event_id % 2 * 2 AS codec, 1 + event_id % 2 AS ch, 8000 + event_id % 5 * 8000 AS rate, event_id % 200 AS al, event_id // 2 % 2 AS b FROM events),
       x AS (SELECT *, (al + 22) * ch AS block FROM w), y AS (SELECT *, (block - 7 * ch) * 8 // (4 * ch) + 2 AS spb FROM x)
       SELECT event_id, CASE WHEN codec = 2 THEN 4 ELSE 8 << b END AS bits_per_sample, CASE WHEN codec = 2 THEN block ELSE ch * (8 << b) // 8 END AS block_align,
       CASE WHEN codec = 2 THEN rate // spb * block ELSE rate * (ch * (8 << b) // 8) END AS byte_rate, CASE WHEN codec = 2 THEN spb END AS samples_per_block FROM y""",
)
def wav_header_math(spark, sf_dir):
    """Header fields of wave files for bank entries."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", fn.wave_header(e % 2 * 2, 1 + e % 2, 8000 + e % 5 * 8000, e % 200, F.floor(e / 2) % 2).alias("h"))
    return rows.select("event_id", "h.bits_per_sample", "h.block_align", "h.byte_rate", "h.samples_per_block")


@query(
    "grid_positions",
    """SELECT p_partkey, p_partkey % p_size AS x, p_partkey // p_size AS y, (p_partkey // p_size) * p_size + p_partkey % p_size AS cell, (p_partkey % p_size) * 16 AS left_px,
       (p_partkey // p_size) * 16 + 16 AS bottom_px FROM part""",
)
def grid_positions(spark, sf_dir):
    """Cells of a grid to places and back, and tile rectangles."""
    size = F.col("p_size").cast("long")
    rows = table(spark, sf_dir, "part").withColumn("c", fn.cell_of(F.col("p_partkey"), size)).withColumn("r", fn.tile_rect(F.col("p_partkey"), size))
    return rows.select("p_partkey", "c.x", "c.y", fn.cell_id(F.col("c.x"), F.col("c.y"), size).alias("cell"), F.col("r.left").alias("left_px"), F.col("r.bottom").alias("bottom_px"))


@query(
    "human_file_size",
    """SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || 'B' WHEN b < 1048576 THEN printf('%.2f', b / 1024.0::DOUBLE) || 'KB' WHEN b < 1073741824 THEN printf('%.2f', b / 1048576.0::DOUBLE) || 'MB'
       ELSE printf('%.2f', b / 1073741824.0::DOUBLE) || 'GB' END AS size FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)""",
)
def human_file_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query(
    "token_parse",
    r"""WITH t AS (SELECT page_id, unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS token FROM pages)
       SELECT CASE WHEN regexp_full_match(token, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(token, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'double' ELSE 'string' END AS kind,
       count(*) AS n, CAST(sum(CASE WHEN regexp_full_match(token, '[+-]?[0-9]+') THEN CAST(token AS BIGINT) END) AS BIGINT) AS total FROM t GROUP BY 1""",
)
def token_parse(spark, sf_dir):
    """Property tokens, typed as integer, double or string."""
    each = table(spark, sf_dir, "pages").select(F.explode(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")).alias("token")).select(fn.typed_token(F.col("token")).alias("t"))
    return each.groupBy("t.kind").agg(F.count("*").alias("n"), F.sum("t.int_value").cast("long").alias("total"))


@query(
    "tuple_reshape",
    """WITH t AS (SELECT vec_id, embedding, unnest(range(16)) AS i FROM embeddings)
       SELECT vec_id, i AS place, CAST(embedding[i * 4 + 1] AS DOUBLE) AS a, CAST(embedding[i * 4 + 4] AS DOUBLE) AS d FROM t""",
)
def tuple_reshape(spark, sf_dir):
    """Flat lists as tuples of four."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(fn.tuples(F.col("embedding"), 4)).alias("place", "t"))
    return each.select("vec_id", F.col("place").cast("long").alias("place"), F.get("t", F.lit(0)).cast("double").alias("a"), F.get("t", F.lit(3)).cast("double").alias("d"))


@query(
    "nearest_divisor",
    f"""WITH d AS (SELECT unnest({list(fn.DIVISORS_OF_2000)}) AS d), j AS (SELECT p_partkey, d, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size * 37 - d), d DESC) AS k FROM part, d)
       SELECT p_partkey, CAST(d AS BIGINT) AS divisor FROM j WHERE k = 1""",
)
def nearest_divisor(spark, sf_dir):
    """The divisor of 2000 nearest to an interval."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.nearest_divisor(F.col("p_size") * 37).cast("long").alias("divisor"))


@query("gcd_lcm", "SELECT p_partkey, gcd(p_partkey, CAST(p_size AS BIGINT) * 6) AS g, lcm(p_partkey, CAST(p_size AS BIGINT) * 6) AS l FROM part")
def gcd_lcm(spark, sf_dir):
    """Common ticks and periods of animations."""
    pair = F.array(F.col("p_partkey"), F.col("p_size").cast("long") * 6)
    return table(spark, sf_dir, "part").select("p_partkey", fn.gcd(pair).alias("g"), fn.lcm(pair).alias("l"))


@query("season_expand", "SELECT r_regionkey, s || '_' || lower(r_name) AS sheet FROM region, (SELECT unnest(['spring', 'summer', 'fall', 'winter']) AS s)")
def season_expand(spark, sf_dir):
    """Seasonal sheets by all their names."""
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(fn.season_names(F.concat(F.lit("spring_"), F.lower("r_name")))).alias("sheet"))


@query("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    """Property values out of JSON."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "bank_name_join",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS k FROM supplier WHERE s_acctbal > 5000)
       SELECT n_nationkey, n_name, s_suppkey, s_name FROM nation LEFT JOIN s ON s_nationkey = n_nationkey AND k = 1""",
)
def bank_name_join(spark, sf_dir):
    """Bank names resolved; of banks with one name the last loaded counts, and unmatched names stay."""
    banks = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    return rel.last_wins_join(table(spark, sf_dir, "nation"), banks, "n_nationkey", "s_suppkey").select("n_nationkey", "n_name", "s_suppkey", "s_name")


@query(
    "category_lookup",
    "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def category_lookup(spark, sf_dir):
    """Ids to names through small tables."""
    named = rel.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    named = rel.lookup(named, table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return named.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "track_to_entry",
    "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_custkey % 7 = l_linenumber - 1",
)
def track_to_entry(spark, sf_dir):
    """Tracks to wave entries by bank and place."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("o_custkey % 7").alias("place"))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("CAST(l_linenumber - 1 AS BIGINT)").alias("place"), "l_linenumber", "l_partkey", "l_suppkey")
    return orders.join(entries, ["o_orderkey", "place"]).drop("place")


@query("semi_used", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def semi_used(spark, sf_dir):
    """Sheet properties of tiles that are in use."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return rel.keep_used(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query("anti_bad", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_bad(spark, sf_dir):
    """Places without the excluded ones."""
    bad = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.drop_bad(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), bad, ["o_orderkey"])


@query(
    "full_outer_merge",
    """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 200 GROUP BY 1, 2)
       SELECT user_id, a.n AS error_n, b.n AS signup_n, c.n AS view_n FROM (SELECT * FROM e WHERE event_type = 'error') a FULL JOIN (SELECT * FROM e WHERE event_type = 'signup') b USING (user_id)
       FULL JOIN (SELECT * FROM e WHERE event_type = 'view') c USING (user_id)""",
)
def full_outer_merge(spark, sf_dir):
    """Day, night and light lists merged by place; as all three come from one table, in one shuffle."""
    return rel.pivoted_counts(table(spark, sf_dir, "events").where("value > 200"), ["user_id"], "event_type", ["error", "signup", "view"], "n")


@query(
    "first_template_match",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
       SELECT c_custkey, s_suppkey, s_name FROM customer JOIN s ON c_nationkey = s_nationkey AND k = 1""",
)
def first_template_match(spark, sf_dir):
    """The first template that matches."""
    templates = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", "s_name")
    return rel.first_match_join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), templates, ["c_nationkey"], "s_suppkey").select("c_custkey", "s_suppkey", "s_name")


@query(
    "positional_align",
    "SELECT l_orderkey, l_linenumber, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_suppkey, l_partkey) AS parts FROM lineitem GROUP BY 1, 2",
)
def positional_align(spark, sf_dir):
    """Cells of same-named layers side by side."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("cell"))
    aligned = rel.align_positions(rows, ["l_orderkey", "l_linenumber"], "l_suppkey", "cell", "cells")
    return aligned.select("l_orderkey", "l_linenumber", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("parts"))


@query("distinct_triplets", "SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def distinct_triplets(spark, sf_dir):
    """(bank, track, category) of cues, once each."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag").distinct()


@query(
    "warp_edges",
    """WITH e AS (SELECT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations)
       SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM e WHERE src <> dst GROUP BY 1""",
)
def warp_edges(spark, sf_dir):
    """Warp graph: distinct targets of each map without self-warps, as adjacency."""
    from pyspark.sql import Window

    steps = table(spark, sf_dir, "conversations").select(F.col("role").alias("src"), F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("dst"))
    return rel.adjacency(rel.edges_without_loops(steps, "src", "dst"), "src", "dst").select("src", F.array_join("targets", ",").alias("targets"))


@query(
    "merge_props_first_key",
    """WITH u AS (SELECT 0 AS part, source, lang, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, source, lang, doc_id FROM documents WHERE doc_id % 2 = 1),
       k AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY part, doc_id) AS r FROM u) SELECT source, lang, doc_id FROM k WHERE r = 1""",
)
def merge_props_first_key(spark, sf_dir):
    """Property lists of merged sheets: of each key the first."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return rel.first_key_union([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")], ["source", "lang"], "doc_id")


@query("light_string_agg", "SELECT r_name, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def light_string_agg(spark, sf_dir):
    """Light tuples as one ordered string."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name").agg(F.expr("listagg(n_name, ' ') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query(
    "entry_length_lead",
    "SELECT event_id, user_id, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts), 0) AS length_us FROM events",
)
def entry_length_lead(spark, sf_dir):
    """Lengths from the following entry's offset; the last one's from the segment's end."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", rel.length_to_next(rows, ["user_id"], ["ts", "event_id"], at, at).alias("length_us"))


@query(
    "entry_gap_lag",
    "SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts) + event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events",
)
def entry_gap_lag(spark, sf_dir):
    """Gaps between an entry and the end of the one before."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", rel.gap_before(["user_id"], ["ts", "event_id"], at, F.col("event_id")).alias("gap_us"))


@query(
    "first_writer_wins",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
       g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM f WHERE r = 1)
       SELECT event_id, user_id, event_type || CASE WHEN c > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS name FROM g""",
)
def first_writer_wins(spark, sf_dir):
    """Names by the first cue that uses a wave, numbered where a cue has several."""
    from pyspark.sql import Window

    first = rel.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    own = Window.partitionBy("event_type")
    number, several = F.row_number().over(own.orderBy("ts", "event_id")) - 1, F.count("*").over(own) > 1
    return first.select("event_id", "user_id", F.concat("event_type", F.when(several, F.concat(F.lit("_"), number.cast("string"))).otherwise("")).alias("name"))


@query(
    "rle_runs",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
       b AS (SELECT *, CAST(sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a)
       SELECT user_id, run, any_value(event_type) AS event_type, CAST(min(place) AS BIGINT) AS first, count(*) AS n FROM b GROUP BY 1, 2""",
)
def rle_runs(spark, sf_dir):
    """Run-length coding of a row of tiles."""
    found = rel.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.select("user_id", F.col("run").cast("long").alias("run"), "event_type", F.col("first").cast("long").alias("first"), "n")


@query(
    "forward_fill_sheet",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""",
)
def forward_fill_sheet(spark, sf_dir):
    """The current sheet carried forward over tiles."""
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", rel.carry_forward(["user_id"], ["ts", "event_id"], value).alias("carried"))


@query(
    "topmost_opaque",
    """WITH t AS (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM t WHERE top IS NULL OR l_linenumber >= top""",
)
def topmost_opaque(spark, sf_dir):
    """Cells without what lies below the topmost opaque layer."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return rel.from_topmost(rows, ["l_orderkey"], F.col("l_linenumber"), F.col("l_returnflag") == "R").drop("l_returnflag")


@query(
    "tick_resample",
    """WITH p AS (SELECT p_partkey, 1 + p_size % 5 AS frames, 10 + p_size % 4 * 10 AS iv FROM part), t AS (SELECT *, unnest(range(24)) AS i FROM p)
       SELECT p_partkey, i AS tick, (i * 5 // iv) % frames AS frame FROM t""",
)
def tick_resample(spark, sf_dir):
    """Frames shown at each tick."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("1 + p_size % 5").alias("frames"), F.expr("10 + p_size % 4 * 10").alias("iv"))
    each = rows.select("p_partkey", F.posexplode(rel.resample(F.col("iv"), F.col("frames"), F.lit(5), F.lit(120))).alias("tick", "frame"))
    return each.select("p_partkey", F.col("tick").cast("long").alias("tick"), F.col("frame").cast("long").alias("frame"))


@query("hex_default_name", "SELECT s_suppkey, lpad(lower(printf('%x', s_suppkey)), 8, '0') AS name FROM supplier")
def hex_default_name(spark, sf_dir):
    """Names of waves that nothing names."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.default_name(F.col("s_suppkey")).alias("name"))


XACT_SQL = """
WITH banks AS (SELECT s_nationkey, max(s_suppkey) AS bank FROM supplier GROUP BY 1),
cues AS (SELECT o_orderkey AS cue, o_custkey, o_custkey % 25 AS nation, o_orderpriority AS category, unnest(range(1 + o_orderkey % 2)) AS sound FROM orders),
used AS (SELECT cue, sound, category, bank, l_partkey AS wave FROM cues JOIN banks ON s_nationkey = nation JOIN lineitem ON l_orderkey = cue AND l_linenumber - 1 = (o_custkey + 3 * sound) % 7),
firsts AS (SELECT *, row_number() OVER (PARTITION BY bank, wave ORDER BY cue, sound) AS r FROM used),
numbered AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY sound, bank, wave) - 1 AS i FROM firsts WHERE r = 1)
SELECT cue, bank, wave, n_name AS bank_name, category, lpad(lower(printf('%x', cue)), 8, '0') || CASE WHEN cue % 2 = 1 THEN '_' || CAST(i AS VARCHAR) ELSE '' END AS name
FROM numbered JOIN supplier ON s_suppkey = bank JOIN nation ON n_nationkey = s_nationkey
"""


@query("xact_flagship", XACT_SQL)
def xact_flagship(spark, sf_dir):
    """Names every wave of an audio project: bank names resolved (the last loaded counts), sounds to entries, first writer wins, numbered where its cue has several sounds.

    Keys alone pass through the shuffles; the bank's name joins last. convert.name_project has the same operator over real project tables.
    """
    from ..operators.xact import first_writer_names

    banks = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_suppkey").alias("bank"))
    cues = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS cue", "CAST(o_custkey % 25 AS INT) AS nation", "o_custkey", "o_orderpriority AS category", "explode(sequence(0L, o_orderkey % 2)) AS sound")
    tracks = rel.lookup(cues.withColumn("track", F.expr("(o_custkey + 3 * sound) % 7")).drop("o_custkey"), banks, "nation").drop("nation")
    entries = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS cue", "CAST(l_linenumber - 1 AS BIGINT) AS track", "l_partkey AS wave")
    used = tracks.join(entries, ["cue", "track"])
    named = first_writer_names(used, ["bank", "wave"], ["cue"], ["sound"], fn.default_name(F.col("cue")), F.col("cue") % 2 == 1, ["category"])
    names = rel.lookup(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS bank", "s_nationkey AS n_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return rel.lookup(named, names, "bank").select("cue", "bank", "wave", F.col("n_name").alias("bank_name"), "category", "name")
