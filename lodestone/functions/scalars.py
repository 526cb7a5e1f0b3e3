"""Arithmetic and text functions of the asset formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import bits

# Names of codes.
CODECS = ("pcm", "xma", "adpcm", "wma")
SEASONS = ("spring", "summer", "fall", "winter")
DIVISORS_OF_2000 = (1, 2, 4, 5, 8, 10, 16, 20, 25, 40, 50, 80, 100, 125, 200, 250, 400, 500, 1000, 2000)


def wave_format(value: Column, version: Column | int = 43) -> Column:
    """struct<codec, channels, rate, align, bits> of a wave bank's 32-bit format; version 1 has another layout, and up to version 3 code 1 is ADPCM."""
    version = F.lit(version) if isinstance(version, int) else version
    old = F.struct(bits(value, 0, 1).alias("codec"), bits(value, 1, 3).alias("channels"), bits(value, 5, 18).alias("rate"), bits(value, 23, 8).alias("align"), bits(value, 31, 1).alias("bits"))
    new = F.struct(bits(value, 0, 2).alias("codec"), bits(value, 2, 3).alias("channels"), bits(value, 5, 18).alias("rate"), bits(value, 23, 8).alias("align"), bits(value, 31, 1).alias("bits"))
    found = F.when(version == 1, old).otherwise(new)
    codec = F.when((version <= 3) & (found["codec"] == 1), F.lit(2).cast("long")).otherwise(found["codec"].cast("long"))
    return F.struct(codec.alias("codec"), *[found[c].cast("long").alias(c) for c in ("channels", "rate", "align", "bits")])


def codec_name(codec: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CODECS)), codec.cast("int")), F.lit("unknown"))


def codec_extension(codec: Column) -> Column:
    """The extension of a wave's file: .wav for the first three codecs, .wma for the fourth, .bin for any other."""
    return F.when(codec.between(0, 2), ".wav").when(codec == 3, ".wma").otherwise(".bin")


#: Format tags that a wave file may have, by what it is used for (1 PCM, 2 MS-ADPCM, 3 IEEE float, 17 IMA4).
USES = {"SoundEffect": (1,), "Xact": (1, 2), "All": (1, 2, 3, 17)}


def codec_allowed(tag: Column, use: str) -> Column:
    return tag.isin(*USES[use])


#: The parameters of a reverb in their order.
REVERB = (
    "reflections_delay_ms reverb_delay_ms position_left position_right position_left_matrix position_right_matrix early_diffusion late_diffusion low_eq_gain low_eq_cutoff high_eq_gain high_eq_cutoff "
    "rear_delay_ms room_filter_frequency_hz room_filter_main_db room_filter_high_frequency_db reflections_gain_db reverb_gain_db decay_time_sec density_pct room_size_feet wet_dry_mix_pct"
).split()


def reverb(values: Column) -> Column:
    """A struct of the 22 parameters of a reverb, by name."""
    return F.struct(*[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(REVERB)])


def joined(values: Column, separator: str = ", ") -> Column:
    """Values as one text; nulls are left out."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)


def unique_name(content: Column) -> Column:
    """A name by content: the same bytes, the same name."""
    return F.substring(F.sha2(content, 256), 1, 16)


def sheet_side(n: Column) -> Column:
    """Tiles along the side of the smallest square sheet that holds n."""
    return F.ceil(F.sqrt(n)).cast("long")


def batch_of(place: Column, most: int) -> Column:
    """The batch of a file by its place, `most` files each; 1 to 15."""
    return F.floor(place / max(1, min(15, most))).cast("long")


def vector_half(a: Column) -> Column:
    """Each value moved to the nearest half-open step: floor of the value and a half."""
    return F.transform(a, lambda x: F.floor(x + F.lit(0.5)).cast("double"))


def vector_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_divide(a: Column, b: Column) -> Column:
    """Null where a divisor is 0."""
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, x / y))


def any_less(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: x < y), lambda t: t)


def category_flags(value: Column) -> Column:
    """struct<fade_type, behavior> of a category's instance flags."""
    return F.struct(bits(value, 0, 3).alias("fade_type"), F.shiftright(value, 3).alias("behavior"))


def visibility_flags(value: Column) -> Column:
    """struct<is_music, is_public> of a category's visibility bits."""
    return F.struct((bits(value, 0, 1) == 1).alias("is_music"), (bits(value, 1, 1) == 1).alias("is_public"))


def cue_is_simple(flags: Column) -> Column:
    return bits(flags, 2, 1) == 1


def variation_type(flags: Column) -> Column:
    return bits(flags, 3, 3)


def event_id(info: Column) -> Column:
    return bits(info, 0, 5)


def wave_header(codec: Column, channels: Column, rate: Column, align: Column, bit: Column) -> Column:
    """struct<bits_per_sample, block_align, byte_rate, samples_per_block> of the header that a bank entry gets.

    PCM: samples of 8 << bit bits. ADPCM: blocks of (align + 22) bytes a channel hold 2 * (align + 16) samples.
    """
    channels = F.greatest(channels, F.lit(1))
    pcm_bits = F.when(bit == 1, 16).otherwise(8).cast("long")
    pcm_align = channels * (pcm_bits / 8).cast("long")
    block = (align + 22) * channels
    per_block = F.floor((block - 7 * channels) * 8 / (4 * channels)).cast("long") + 2
    adpcm = codec == 2
    return F.struct(
        F.when(adpcm, F.lit(4).cast("long")).otherwise(pcm_bits).alias("bits_per_sample"), F.when(adpcm, block).otherwise(pcm_align).alias("block_align"),
        F.when(adpcm, F.floor(rate / per_block).cast("long") * block).otherwise(rate * pcm_align).alias("byte_rate"), F.when(adpcm, per_block).alias("samples_per_block"),
    )


def pack_rgb565(red: Column, green: Column, blue: Column) -> Column:
    """16 bits of three 0..255 channels, each rounded to its width."""
    r, g, b = (F.floor(c * top / F.lit(255.0) + 0.5).cast("long") for c, top in ((red, 31), (green, 63), (blue, 31)))
    return r * 2048 + g * 32 + b


def unpack_rgb565(value: Column) -> Column:
    """struct<red, green, blue>, widened to eight bits by repeating the high bits."""
    r, g, b = bits(value, 11, 5), bits(value, 5, 6), bits(value, 0, 5)
    return F.struct((r * 8 + F.shiftright(r, 2)).alias("red"), (g * 4 + F.shiftright(g, 4)).alias("green"), (b * 8 + F.shiftright(b, 2)).alias("blue"))


def premultiply(channel: Column, alpha: Column) -> Column:
    return F.floor(channel * alpha / 255).cast("long")


def unpremultiply(channel: Column, alpha: Column) -> Column:
    """The channel before premultiplication, at most 255; 0 where nothing can be known (alpha and channel 0)."""
    return F.when(alpha == 0, F.when(channel == 0, 0).otherwise(255)).otherwise(F.least(F.ceil(channel * 255 / alpha), F.lit(255))).cast("long")


def dxt_bytes(width: Column, height: Column, block: int) -> Column:
    return (F.ceil(width / 4) * F.ceil(height / 4) * block).cast("long")


def cell_id(x: Column, y: Column, width: Column) -> Column:
    return y * width + x


def cell_of(cell: Column, width: Column) -> Column:
    """struct<x, y> of a grid cell."""
    return F.struct((cell % width).alias("x"), F.floor(cell / width).cast("long").alias("y"))


def tile_rect(index: Column, columns: Column, side: int = 16) -> Column:
    """struct<left, top, right, bottom> in pixels of a tile on its sheet."""
    left, top = (index % columns) * side, F.floor(index / columns).cast("long") * side
    return F.struct(left.alias("left"), top.alias("top"), (left + side).alias("right"), (top + side).alias("bottom"))


def tile_key(sheet: Column, index: Column) -> Column:
    return F.concat_ws("@", sheet, index.cast("string"))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    return (
        F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1 << 20, F.concat(F.format_string("%.2f", size / float(1 << 10)), F.lit("KB")))
        .when(size < 1 << 30, F.concat(F.format_string("%.2f", size / float(1 << 20)), F.lit("MB")))
        .otherwise(F.concat(F.format_string("%.2f", size / float(1 << 30)), F.lit("GB")))
    )


def epoch_text(millis: Column) -> Column:
    """Milliseconds since the epoch as year/month/day hour:minute of UTC, in any session time zone; a year from 0 on has four digits at least, and none a plus sign."""
    in_day = F.pmod(millis, F.lit(86_400_000))
    day = F.date_from_unix_date(F.call_function("div", millis - in_day, F.lit(86_400_000)).cast("int"))
    year, minute = F.year(day), F.call_function("div", in_day, F.lit(60_000))
    digits = F.when(year.between(0, 999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(digits, F.lit("/"), F.month(day), F.lit("/"), F.day(day), F.lit(" "), F.call_function("div", minute, F.lit(60)), F.lit(":"), minute % 60)


def typed_token(token: Column) -> Column:
    """struct<kind, int_value, double_value, string_value>: an integer if it is one, else a double, else a string."""
    i, d = token.try_cast("int"), token.try_cast("double")
    whole = token.rlike(r"^[+-]?[0-9]+$") & i.isNotNull()
    real = ~whole & token.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.struct(
        F.when(whole, "int").when(real, "double").otherwise("string").alias("kind"), F.when(whole, i).alias("int_value"), F.when(real, d).alias("double_value"), F.when(~whole & ~real, token).alias("string_value")
    )


def tokens(value: Column) -> Column:
    """Tokens of a property string, typed."""
    return F.transform(F.split(value, " "), typed_token)


def tuples(values: Column, n: int) -> Column:
    """The values as consecutive tuples of n; an incomplete tail is dropped."""
    places = F.when(F.size(values) >= n, F.sequence(F.lit(0), F.floor(F.size(values) / n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(values, i * n + 1, F.lit(n)))


def nearest_divisor(value: Column) -> Column:
    """The divisor of 2000 nearest to a value; of two, the larger."""
    each = F.transform(F.array(*map(F.lit, DIVISORS_OF_2000)), lambda d: F.struct(F.abs(value - d).alias("away"), (-d).alias("minus")))
    return -F.array_min(each)["minus"]


def gcd(values: Column) -> Column:
    """Greatest common divisor of an array of non-negative integers: Euclid's steps as a fold."""

    def pair(a: Column, b: Column) -> Column:
        start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(91)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))), lambda s: s["a"])

    return F.aggregate(values, F.lit(0).cast("long"), pair)


def lcm(values: Column) -> Column:
    """Least common multiple of integers from 0 on, in 64 bits, dividing first; 0 where one is 0."""
    return F.aggregate(values, F.lit(1).cast("long"), lambda s, v: F.when((s == 0) | (v == 0), F.lit(0).cast("long")).otherwise(F.call_function("div", s, gcd(F.array(s, v.cast("long")))) * v))


def season_names(name: Column) -> Column:
    """The four names of a seasonal sheet, whose own name says spring."""
    rest = F.replace(name, F.lit("spring_"), F.lit(""))
    return F.array(*[F.concat(F.lit(f"{s}_"), rest) for s in SEASONS])


def default_name(index: Column) -> Column:
    return F.lpad(F.lower(F.hex(index)), 8, "0")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def change_extension(path: Column, to: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(to))


def variable_mask(n: Column) -> Column:
    """n low bits set (speaker mask of n channels)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def clamp(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))
