"""Benchmark decontamination (10): template canonicalisation, by DataFrame functions only.

Numbers, names and units become typed placeholders, letters lower case, punctuation goes. Windows of the
resulting words are hashed; those of documents meet those of benchmark items in a hash join. An item is found in a document
where enough of its windows are, and where its slots are filled consistently: in one alignment, one value of
the item always has one value in the document, whatever it is. So a question with other numbers or names is caught
as well as a copy. Windows that are placeholders for the most part say little, so those are hashed as they are written: an item
that has no others is found where its own numbers and names are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 5
COVERAGE = 0.6
CONSISTENT = 0.8
#: Windows of the benchmark up to this many are broadcast (24 bytes each); more are joined by shuffle.
MOST_BROADCAST = 500_000

NUMBER, NAME, UNIT, POINT = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use characters
# Punctuation that is dropped, and units of measure.
PUNCTUATION = ",.!?;:\"'`()[]{}<>*#$%&|/\\=+-_~^«»“”„‘’…–—¿¡"
UNITS = "mm cm m km mi ft in yd g kg mg t lb lbs oz l ml s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years km/h kmh mph kw kwh w v a hz khz mhz ghz kb mb gb tb usd eur gbp euro euros dollar dollars cent cents percent meter meters metre metres mile miles gram grams liter liters litre litres degree degrees"
SPACES = r"[ \x09-\x0D]+"


def canonical_text(text: Column) -> Column:
    """The text with placeholders; white space stays where it was, so its pieces match the text's one to one."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}'’-]*", NAME)
    counted = F.when(named.rlike("[0-9]"), F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", NUMBER)).otherwise(named)
    plain = F.translate(F.lower(counted), PUNCTUATION, "")
    units = "|".join(sorted({u.replace("/", "") for u in UNITS.split()}, key=lambda u: (-len(u), u)))
    return F.when(F.contains(plain, F.lit(NUMBER)), F.regexp_replace(plain, rf"({NUMBER} ?)(?:{units})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")).otherwise(plain)


def written_text(text: Column) -> Column:
    """The text in lower case, without punctuation but that within numbers; its pieces match those of canonical_text() one to one."""
    marked = F.when(text.rlike("[0-9][.,][0-9]"), F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", POINT)).otherwise(text)
    return F.translate(F.lower(marked), PUNCTUATION, "")


def with_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, pairs) of rows with `text`: the canonical words, each with the word as written, which is null where the text has no placeholders."""
    seen = rows.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("canonical", canonical_text(F.col("text")))
    words = F.split("canonical", SPACES)
    zipped = F.arrays_zip(words.alias("word"), F.split(written_text(F.col("text")), SPACES).alias("written"))
    plain = F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("written")))
    has = F.col("canonical").rlike(f"[{NUMBER}{NAME}{UNIT}]")
    return seen.select(*keys, F.filter(F.when(has, zipped).otherwise(plain), lambda z: z["word"] != "").alias("pairs"))


def _literal(word: Column) -> Column:
    """Whether a word is more than placeholders."""
    return F.translate(word, NUMBER + NAME + UNIT, "") != ""


def with_hashes(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, h, r, l) of rows with `pairs`: hashes of the canonical words and of the words as written, and 1 for words that are more than placeholders.

    The last two are empty where there are no placeholders.
    """
    mixed = F.when(F.get("pairs", F.lit(0))["written"].isNotNull(), F.col("pairs")).otherwise(F.slice("pairs", 1, 0))
    rows = rows.select(*keys, "pairs", mixed.alias("mixed"))
    return rows.select(
        *keys, F.transform("pairs", lambda z: F.xxhash64(z["word"])).alias("h"), F.transform("mixed", lambda z: F.xxhash64(z["written"])).alias("r"), F.transform("mixed", lambda z: _literal(z["word"]).cast("int")).alias("l"),
    )


def _is_light(at: Column, size: int) -> Column:
    """Whether more than half of a window's words are more than placeholders."""
    return 2 * reduce(Column.__add__, [F.get(F.col("l"), at + F.lit(j)) for j in range(size)]) > size


def _canonical_hash(at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col("h"), at + F.lit(j)) for j in range(size)])


def _window_hash(at: Column, size: int) -> Column:
    """The hash of the canonical words of a window, or of the written ones where it is placeholders for the most part."""
    return F.when((F.size("l") == 0) | _is_light(at, size), _canonical_hash(at, size)).otherwise(F.xxhash64(F.lit("="), *[F.get(F.col("r"), at + F.lit(j)) for j in range(size)]))


def _hash_all(places: Column, size: int) -> Column:
    return F.when(F.size("l") == 0, F.transform(places, lambda i: _canonical_hash(i, size))).otherwise(F.transform(places, lambda i: _window_hash(i, size)))


def window_hashes(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, at, hash): every window of each size of the rows' `pairs`; windows of different sizes never share a hash input."""
    hashed = with_hashes(rows, key)
    n = F.size("h")
    found = []
    for size in sizes:
        places = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        found.append(hashed.select(key, F.posexplode(_hash_all(places, size)).alias("at", "hash")).withColumn("width", F.lit(size)))
    return reduce(DataFrame.union, found)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, at, hash, width, n_windows) of the windows that identify an item: more than half of their words aren't placeholders.

    An item that has no such window has all of its windows. An item of fewer than `width` words has one window, all of it.
    In a document an item's first word may follow others and then count as a name or a unit, so the first window has a hash for each case.
    """
    text = F.ltrim(F.coalesce(F.col("text"), F.lit("")))
    rows = items.select("item_id", F.explode(F.array(F.lit(""), F.lit("x "), F.lit("5 "))).alias("before"), text.alias("text"))
    rows = with_pairs(rows.select("item_id", "before", F.concat("before", "text").alias("text")), "item_id", "before")
    rows = rows.withColumn("pairs", F.when(F.col("before") == "", F.col("pairs")).otherwise(F.slice("pairs", F.lit(2), F.greatest(F.size("pairs") - 1, F.lit(0))))).where(F.size("pairs") > 0)
    words = with_hashes(rows, "item_id", "before").withColumn("width", F.least(F.size("h"), F.lit(width)))
    last = F.when(F.col("before") == "", F.size("h") - F.col("width")).otherwise(0)
    each = words.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    hashed, light = F.when(F.lit(False), F.lit(0).cast("long")), F.when(F.lit(False), F.lit(False))
    for size in range(1, width + 1):
        hashed = hashed.when(F.col("width") == size, _window_hash(F.col("at"), size))
        light = light.when(F.col("width") == size, (F.size("l") == 0) | _is_light(F.col("at"), size))
    each = each.select("item_id", "at", "width", hashed.alias("hash"), (light & (F.col("before") == "")).alias("light"))
    places = each.groupBy("item_id", "at").agg(F.max("light").alias("light"))
    items_light = places.groupBy("item_id").agg(F.max("light").alias("any_light"), F.count_if("light").alias("n_light"), F.count("*").alias("n"))
    kept = places.join(items_light, "item_id").where("light OR NOT any_light").select("item_id", "at", F.when(F.col("any_light"), F.col("n_light")).otherwise(F.col("n")).alias("n_windows"))
    return each.select("item_id", "at", "hash", "width").distinct().join(kept, ["item_id", "at"]).select("item_id", "at", "hash", "width", "n_windows")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT,
) -> DataFrame:
    """(id, item_id, n_windows, matched, coverage, n_slots, consistent_slots) of each document and benchmark item found in it.

    An item is found where one alignment has at least `coverage` of its distinct windows and at least
    `consistent` of its slots (item values at placeholders) have a single value in it; copies have no slots or consistent ones.
    An alignment is one shift between document and item, or a run of shifts that are few words apart, as edits make them. The figures are those
    of the alignment that covers most. Null and empty
    texts hold nothing; an item without words is never found, one of placeholders for the most part only with its own numbers and names. Rows of the same id count
    together (null ids as one), as do items. Empty tables give no rows; further columns aren't read.
    """
    items = materialize(item_windows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), width), "item_windows")
    n = items.count()
    sizes = sorted({r["width"] for r in items.select("width").distinct().collect()})
    if not sizes:
        return docs.select(id_col).where("false").crossJoin(items.select("item_id", "n_windows").limit(0)).selectExpr(
            f"`{id_col}`", "item_id", "n_windows", "0L AS matched", "0D AS coverage", "0L AS n_slots", "0L AS consistent_slots"
        )
    rows = with_pairs(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), "key")
    probe = items.select(F.col("item_id"), F.col("at").alias("p"), "hash", F.col("width"), "n_windows")
    if n <= MOST_BROADCAST:
        probe = F.broadcast(probe)
    hits = window_hashes(rows, "key", sizes).join(probe, ["hash", "width"]).select("key", "item_id", F.col("at").alias("q"), "p", "width", "n_windows")
    hits = materialize(hits, "hits")
    found = hits.groupBy("key", "item_id").agg(F.first("n_windows").alias("n_windows"), F.count_distinct("p").alias("matched")).where(F.col("matched") >= coverage * F.col("n_windows"))
    found = found.select(F.col("key").alias("k"), F.col("item_id").alias("i"))  # no alignment covers more than all of them do together
    hits = hits.join(found, hits["key"].eqNullSafe(found["k"]) & (hits["item_id"] == found["i"]), "left_semi")
    aligned = materialize(_aligned(hits, coverage), "aligned")
    slots = _slots(docs, benchmark, aligned, id_col, text_col, item_col, item_text)
    known = aligned.select("key", "item_id", "low", "high", "n_windows", "matched").distinct()
    same = known["key"].eqNullSafe(slots["slot_key"]) & (known["item_id"] == slots["slot_item"]) & (known["low"] == slots["slot_low"]) & (known["high"] == slots["slot_high"])
    both = known.join(slots, same, "left").select("key", "item_id", "low", "high", "n_windows", "matched", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_slots", "consistent_slots")))
    both = both.where((F.col("n_slots") == 0) | (F.col("consistent_slots") >= consistent * F.col("n_slots")))
    best = F.max(F.struct("matched", (-F.col("high") + F.col("low")).alias("near"), F.col("low"), "n_windows", "n_slots", "consistent_slots")).alias("best")
    return both.groupBy("key", "item_id").agg(best).select(
        F.col("key").alias(id_col), "item_id", "best.n_windows", "best.matched", (F.col("best.matched") / F.col("best.n_windows")).alias("coverage"), "best.n_slots", "best.consistent_slots",
    )


def _aligned(hits: DataFrame, coverage: float) -> DataFrame:
    """(key, item_id, shift, p, width, n_windows, low, high, matched): the hits of each alignment, from shift `low` to `high`, that covers enough of its item.

    Each shift is an alignment; so is each run of shifts with gaps of at most a quarter of the item's windows (one word at least).
    """
    hits = hits.withColumn("shift", F.col("q") - F.col("p")).select("key", "item_id", "shift", "p", "width", "n_windows").distinct()
    order = Window.partitionBy("key", "item_id").orderBy("shift")
    gap = F.col("shift") - F.lag("shift").over(order)
    shifts = hits.select("key", "item_id", "shift", "n_windows").distinct().withColumn("new", F.coalesce((gap > F.greatest(F.lit(1), F.col("n_windows") / 4)).cast("int"), F.lit(1)))
    runs = shifts.withColumn("run", F.sum("new").over(order))
    ends = Window.partitionBy("key", "item_id", "run")
    runs = runs.select(F.col("key").alias("k"), F.col("item_id").alias("i"), F.col("shift").alias("s"), F.min("shift").over(ends).alias("low"), F.max("shift").over(ends).alias("high"))
    wide = runs.where("low < high")
    of_runs = hits.join(wide, hits["key"].eqNullSafe(wide["k"]) & (hits["item_id"] == wide["i"]) & (hits["shift"] == wide["s"])).select(*hits.columns, "low", "high")
    every = hits.withColumns({"low": F.col("shift"), "high": F.col("shift")}).union(of_runs)
    covered = every.groupBy("key", "item_id", "low", "high").agg(F.first("n_windows").alias("n"), F.count_distinct("p").alias("matched")).where(F.col("matched") >= coverage * F.col("n"))
    covered = covered.select(F.col("key").alias("k"), F.col("item_id").alias("i"), F.col("low").alias("l"), F.col("high").alias("u"), "matched")
    same = every["key"].eqNullSafe(covered["k"]) & (every["item_id"] == covered["i"]) & (every["low"] == covered["l"]) & (every["high"] == covered["u"])
    return every.join(covered, same).drop("k", "i", "l", "u")


def _placeholder_words(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, kind, value): the words as written at placeholders, by their place among the canonical words."""
    each = with_pairs(rows.select(key, "text"), key).select(key, F.posexplode("pairs").alias("at", "z"))
    return each.where(F.col("z.word").rlike(f"[{NUMBER}{NAME}{UNIT}]")).select(key, "at", F.col("z.word").alias("kind"), F.col("z.written").alias("value"))


def _slots(docs: DataFrame, benchmark: DataFrame, aligned: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(slot_key, slot_item, slot_low, slot_high, n_slots, consistent_slots) of the alignments that have slots at all."""
    ours = _placeholder_words(benchmark.select(F.col(item_col).alias("slot_item"), F.col(item_text).alias("text")), "slot_item").withColumnRenamed("at", "slot_at")
    ours = materialize(ours.select("slot_item", "slot_at", "kind", F.col("value").alias("own")), "item_slots")
    places = aligned.select("key", "item_id", "low", "high", "shift", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("width") - 1)).alias("place")).distinct()
    places = materialize(places.join(ours, (F.col("item_id") == F.col("slot_item")) & (F.col("place") == F.col("slot_at"))).drop("slot_item", "slot_at"), "slots")
    wanted = places.select("key").distinct()
    texts = docs.select(F.col(id_col).alias("slot_key"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, texts["slot_key"].eqNullSafe(wanted["key"]), "left_semi")
    theirs = _placeholder_words(texts, "slot_key").select("slot_key", F.col("at").alias("slot_at"), F.col("kind").alias("their_kind"), "value")
    met = places.join(theirs, places["key"].eqNullSafe(theirs["slot_key"]) & (F.col("place") + F.col("shift") == F.col("slot_at")) & (F.col("kind") == F.col("their_kind")))
    values = met.groupBy("key", "item_id", "low", "high", "kind", "own").agg(F.count_distinct("value").alias("different"))
    slots = values.groupBy("key", "item_id", "low", "high").agg(F.count("*").alias("n_slots"), F.count_if(F.col("different") == 1).alias("consistent_slots"))
    return slots.select(*(F.col(c).alias(f"slot_{n}") for c, n in (("key", "key"), ("item_id", "item"), ("low", "low"), ("high", "high"))), "n_slots", "consistent_slots")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item is found. Rows of the same id count together; rows without an id do where their texts are equal."""
    own = "clean_key"
    while own in docs.columns:
        own += "_"
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.withColumn(own, F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), text)))
    gone = materialize(contaminated(keyed, benchmark, own, text_col, **options).select(own).distinct(), "contaminated")
    return keyed.join(gone, own, "left_anti").select(*docs.columns)
