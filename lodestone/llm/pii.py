"""PII (1): candidate generation, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

Base spans follow fixed patterns and checks and always stay. Wider generators propose further, overlapping
candidates: written-out mail addresses, national phone numbers, shorter card numbers, version-6 addresses, passwords and keys. Each candidate has
binned features of its form and its surroundings; whether it passes its generator's check is one of them. The trees learn from sentences made
by rule, with spans at known places and look-alikes beside them (`sentences`). As features are bins, the training data are
counts per cell of bins, and the driver boosts over some hundreds of cells. The
trees become one SQL expression; per family, the threshold is the least score that reaches the wanted precision on held-out sentences.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# The base patterns. Possessive runs and the guard in front keep long runs linear and match the same spans.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"  # shorter runs can't have 16 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# The wider generators' patterns.
MAIL_SPELLED = rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\((?:at|AT)\)|\[(?:at|AT)\]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?:(?:\.| ?\((?:dot|DOT)\) ?| ?\[(?:dot|DOT)\] ?| dot )[A-Za-z0-9-]++)++"
_GROUP = "[0-9A-Fa-f]{1,4}"
IP_SIX = rf"(?<![0-9A-Za-z:])(?:(?:{_GROUP}:){{5,7}}{_GROUP}|(?:(?:{_GROUP}:){{1,7}}:|::(?={_GROUP}))(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![0-9A-Za-z:])"
CARD_SHORT = r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9A-Za-z]|[\x20-][0-9])"
PHONE_NATIONAL = r"(?<![0-9A-Za-z.+-])(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9A-Za-z]|[.-][0-9])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DATE = r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2})$"
FOR_IT = "mail|e-mail|contact|call|phone|tel|fax|mobile|cell|card|visa|master|amex|credit|payment|ip|host|server|address"
AGAINST = "version|isbn|issn|order|invoice|page|chapter|section|serial|hash|commit|checksum|digest|sha|md5|uuid|id|no\\.|number|part|ticket"
_KEY = "(?i:token|secret|password|passwd|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer)"
SECRET = rf"(?<={_KEY}[\"' ]{{0,3}}(?:=|:|=>|(?<= )is(?= ))[\"' ]{{0,3}})[A-Za-z0-9_+/=.!@#$%^&*-]{{6,}}+"
_KEYISH = "[A-Za-z0-9_+/=-]"
KEY_LIKE = rf"(?<!{_KEYISH})(?={_KEYISH}*[0-9])(?={_KEYISH}*[A-Za-z]){_KEYISH}{{20,}}+"

FEATURES = ("generator", "digits", "length", "separators", "before", "after", "context", "valid", "shape", "spelled")
ROUNDS = 60
RATE = 0.3
PRECISION = 0.98


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits' checksum holds."""
    each = F.transform(F.filter(F.split(F.reverse(digits_of(value)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    twice = F.transform(each, lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(twice, F.lit(0), lambda a, v: a + v) % 10 == 0


def n_digits(value: Column) -> Column:
    return F.length(digits_of(value))


@dataclass(frozen=True)
class Generator:
    """A source of candidates. `worth` says which texts can have any at all, at little cost."""

    name: str
    family: int
    pattern: str
    worth: str
    base: bool = False

    def valid(self, value: Column) -> Column:
        if self.name == "ip":
            return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
        if self.name == "card":
            return n_digits(value).between(16, 19) & luhn(value)
        if self.name == "phone":
            return n_digits(value).between(8, 15)
        if self.name == "mail_spelled":
            return F.lower(value).rlike(r"(?:\.|dot[)\]]?) ?[a-z]{2,6}$") & ~value.rlike(r"[.][A-Z][a-z]")  # "at home.Then" is prose
        if self.name == "ip_six":
            groups = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
            return (value.rlike(f"^(?:{_GROUP}:){{7}}{_GROUP}$") | (value.contains("::") & (groups <= 7))) & value.rlike("[0-9]")
        if self.name == "card_short":
            return n_digits(value).between(13, 15) & luhn(value) & value.rlike("^[3-6]")
        if self.name == "secret":
            return (n_digits(value) > 0) & value.rlike("[A-Za-z]")
        if self.name == "key_like":
            return n_digits(value) >= 4
        if self.name == "phone_national":
            return n_digits(value).between(9, 15) & ~value.rlike(DATE) & (value.contains("(") | value.startswith("00") | value.startswith("0"))
        return F.lit(True)


GENERATORS = (
    Generator("email", 0, EMAIL, "contains(text, '@')", True),
    Generator("ip", 1, IP, "text rlike '[0-9][.][0-9]'", True),
    Generator("card", 2, CARD, "digits", True),
    Generator("phone", 3, PHONE, "contains(text, '+')", True),
    Generator("mail_spelled", 0, MAIL_SPELLED, "text rlike '[(\\\\[](?:at|AT)[)\\\\]]' OR contains(text, ' at ')"),
    Generator("ip_six", 1, IP_SIX, "text rlike '[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]'"),
    Generator("card_short", 2, CARD_SHORT, "digits"),
    Generator("phone_national", 3, PHONE_NATIONAL, "digits"),
    Generator("secret", 4, SECRET, f"text rlike '{_KEY}'"),
    Generator("key_like", 4, KEY_LIKE, "digits"),
)

SPAN = "array<struct<start:int,end:int,value:string>>"


def _places(matches: str, pattern: str) -> Column:
    """Start and end (exclusive, in code points) of each match: what lies between the matches gives the offsets."""
    between = F.split("text", pattern, -1)
    zipped = F.zip_with(F.slice(between, 1, F.size(matches)), F.col(matches), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(s: Column, z: Column) -> Column:
        start = s["at"] + z["gap"]
        end = start + F.length(z["value"])
        return F.struct(end.alias("at"), F.array_append(s["found"], F.struct(start.alias("start"), end.alias("end"), z["value"].alias("value"))).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(zipped, empty, step, lambda s: s["found"])).otherwise(F.array().cast(SPAN))


def _side(c: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 quote or bracket, 4 anything else."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike("^[\"'()\\[\\]<>=:]"), 3).otherwise(4)


def _candidate(g: Generator, s: Column) -> Column:
    value, text = s["value"], F.col("text")
    before = F.lower(F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))))
    before = F.when(s["start"] == 0, F.lit("")).otherwise(before)
    context = F.when(before.rlike(rf"(?:^|[^a-z])(?:{FOR_IT})(?:[^a-z]|$)"), 2).when(before.rlike(rf"(?:^|[^a-z])(?:{AGAINST})(?:[^a-z]|$)"), 0).otherwise(1)
    n, size = n_digits(value), F.length(value)
    bare = F.regexp_replace(value, "[ ().:-]", "")
    shape = F.when(bare.rlike("^[A-Za-z]*$"), 0).when(bare.rlike("^[0-9]*$"), 1).when(bare.rlike("^[0-9A-Za-z]*$"), 2).otherwise(3)
    parts = F.length(F.regexp_replace(value, "[^ ().@:-]", ""))
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(g.base).alias("base"), g.valid(value).cast("int").alias("valid"), F.lit(g.family).alias("family"), F.lit(GENERATORS.index(g)).alias("generator"),
        F.when(n == 0, 0).when(n < 8, 1).when(n < 12, 2).when(n < 16, 3).when(n < 20, 4).otherwise(5).alias("digits"),
        F.when(size < 10, 0).when(size < 16, 1).when(size < 24, 2).when(size < 40, 3).otherwise(4).alias("length"),
        F.least(parts, F.lit(5)).alias("separators"),
        _side(F.substring(before, -1, 1)).alias("before"), _side(F.substring(text, s["end"] + 1, F.lit(1))).alias("after"), context.alias("context"), shape.alias("shape"), F.when(value.rlike("[(\\[]| dot "), 1).otherwise(0).alias("spelled"),
    )


CANDIDATE = "array<struct<start:int,end:int,base:boolean,valid:int,family:int,generator:int,digits:int,length:int,separators:int,before:int,after:int,context:int,shape:int,spelled:int>>"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, candidates): all generators' candidates of each whole text, the base ones by kind and start first."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    for g in GENERATORS:
        rows = rows.withColumn(f"m_{g.name}", F.when(F.expr(g.worth), F.regexp_extract_all("text", F.lit(g.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({f"s_{g.name}": _places(f"m_{g.name}", g.pattern) for g in GENERATORS})
    every = F.concat(*[_described(g) for g in GENERATORS])
    return rows.select("id", every.cast(CANDIDATE).alias("candidates"))


def _described(g: Generator) -> Column:
    return F.transform(f"s_{g.name}", lambda s: _candidate(g, s))


# --- boosting over cells of bins ----------------------------------------------------------------------


@dataclass
class Model:
    """Trees of two levels: (feature, cut, left feature, left cut, right feature, right cut, four leaves)."""

    prior: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x: dict) -> float:
        return self.prior + sum(leaf[(2 if x[f] > c else 0) + (1 if x[rf if x[f] > c else lf] > (rc if x[f] > c else lc) else 0)] for f, c, lf, lc, rf, rc, leaf in self.trees)

    def expression(self, x: Column) -> Column:
        total = F.lit(self.prior)
        for f, c, lf, lc, rf, rc, leaf in self.trees:
            left = F.when(x[lf] > lc, leaf[1]).otherwise(leaf[0])
            right = F.when(x[rf] > rc, leaf[3]).otherwise(leaf[2])
            total = total + F.when(x[f] > c, right).otherwise(left)
        return total


def _split(cells: list[tuple[dict, float, float]]) -> tuple[str, int, float]:
    """The cut with the greatest Newton gain over (features, gradient, curvature) cells."""
    all_g, all_h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (FEATURES[0], 99, 0.0)
    for name in FEATURES:
        sums: dict[int, list[float]] = {}
        for x, g, h in cells:
            s = sums.setdefault(x[name], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g = h = 0.0
        for value in sorted(sums)[:-1]:
            g, h = g + sums[value][0], h + sums[value][1]
            gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
            if gain > best[2] + 1e-9:
                best = (name, value, gain)
    return best


def boost(cells: list[dict]) -> Model:
    """Gradient boosting with log loss over counted cells: dicts of the features, and of pos, neg, held_pos, held_neg."""
    cells = sorted(cells, key=lambda c: tuple(c[f] for f in FEATURES))
    pos, neg = sum(c["pos"] for c in cells), sum(c["neg"] for c in cells)
    model = Model(math.log((pos + 1) / (neg + 1)))
    scores = [model.prior] * len(cells)
    for _ in range(ROUNDS if pos and neg else 0):
        grads = []
        for c, s in zip(cells, scores, strict=True):
            p = 1 / (1 + math.exp(-max(-30, min(30, s))))
            n = c["pos"] + c["neg"]
            grads.append((c, c["pos"] - n * p, n * p * (1 - p)))
        f, cut, gain = _split(grads)
        if not gain:
            break
        left, right = [x for x in grads if x[0][f] <= cut], [x for x in grads if x[0][f] > cut]
        lf, lc, _ = _split(left)
        rf, rc, _ = _split(right)
        leaf = []
        for side, sf, sc in ((left, lf, lc), (right, rf, rc)):
            for up in (False, True):
                own = [x for x in side if (x[0][sf] > sc) == up]
                leaf.append(RATE * sum(x[1] for x in own) / (sum(x[2] for x in own) + 1))
        model.trees.append((f, cut, lf, lc, rf, rc, tuple(leaf)))
        scores = [model.score(c) for c in cells]
    for family in range(len(ALL_KINDS)):
        own = sorted(((s, c) for s, c in zip(scores, cells, strict=True) if c["family"] == family), key=lambda x: -x[0])
        good = bad = 0
        model.thresholds[family] = math.inf
        for s, c in own:
            good, bad = good + c["held_pos"], bad + c["held_neg"]
            if good and good >= PRECISION * (good + bad):
                model.thresholds[family] = s
    return model


SENTENCES = 16_000


def _pick(i: int, options: str) -> str:
    words = options.split("|")
    return f"element_at(array({', '.join(repr(w) for w in words)}), CAST(pmod(xxhash64(id, {i}), {len(words)}) + 1 AS INT))"


def _digits(i: int, n: int) -> str:
    return f"lpad(CAST(pmod(xxhash64(id, {i}), {10**n}) AS STRING), {n}, '0')"


def _hex(i: int, n: int) -> str:
    return f"substring(sha2(CAST(xxhash64(id, {i}) AS STRING), 256), 1, {n})"


def _join(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _makers() -> list[tuple[str, str, bool]]:
    """(what stands before it, the value, whether it is a span) of each kind of sentence, as SQL over a row's id."""
    name, word, other = _pick(2, "ann|bert|carla|d.miller|eva_k|frank77|g-h|info|sales"), _pick(3, "house|river|market|noon|school|work|night|least"), _pick(4, "Then|There|She|We|It")
    host, top = _pick(5, "mail|post-box|company|uni-town|web7"), _pick(6, "org|com|net|de|info")
    mails = (_join(name, _pick(7, " (at) | [at] |(at)|[at]| (AT) "), host, _pick(8, " (dot) | [dot] |."), top), _join(name, "' at '", host, _pick(8, " dot |."), top))
    groups = [f"lower(hex(pmod(xxhash64(id, {20 + k}), 65536)))" for k in range(8)]
    six = f"concat_ws(':', {', '.join(groups)})"
    short = _join(_pick(9, "2001:db8|fe80|fd00:1|2a02"), "'::'", groups[0], _pick(10, "|:1|:2:3"))
    clock = _join(_digits(11, 2), "':'", _digits(12, 2), "':'", _digits(13, 2), _pick(14, "|:00|:12:07|:1:2:3"))
    mac = f"concat_ws(':', {', '.join(_hex(30 + k, 2) for k in range(6))})"
    card = _pick(15, "3782 |4539-|51|60")
    phone = [
        _join("'(0'", _digits(40, 3), "') '", _digits(41, 3), _pick(42, " |-"), _digits(43, 4)), _join("'0'", _digits(40, 2), "' '", _digits(41, 4), "' '", _digits(43, 4)),
        _join(_pick(44, "0049|0033|0044|001"), "' '", _digits(40, 2), "' '", _digits(41, 3), "' '", _digits(43, 4)), _join("'0'", _digits(40, 3), _pick(42, "-|.| "), _digits(41, 3), _pick(42, "-|.| "), _digits(43, 3)),
    ]
    numbers = [
        _join(_pick(45, "1999|2007|2024"), "'-'", _digits(46, 2), "'-'", _digits(47, 2), _pick(48, "| 10")), _join(_digits(46, 2), "'.'", _digits(47, 2), "'.'", _pick(45, "1999|2007|2024")),
        _join(_digits(46, 2), "'.'", _digits(47, 2), "'.'", _digits(48, 3), "'.'", _digits(49, 2)), _join("'978-'", _digits(46, 2), "'-'", _digits(47, 4), "'-'", _digits(48, 3)),
        _join(_digits(46, 2), "' '", _digits(47, 3), "' '", _digits(48, 3)), _join(_digits(46, 3), "'-'", _digits(47, 3), "' '", _digits(48, 3)),
    ]
    secret = _pick(50, 'token = "|secret: |password is |api_key=|API key: "|access_key = |Bearer: |passwd=|pwd: ')
    values = [_hex(51, 40), _hex(52, 16), _join("'sk_'", _hex(53, 24)), f"base64(CAST({_hex(54, 18)} AS BINARY))", _join(_pick(55, "Blue|Rain|xK|tiger"), _digits(56, 3), _pick(57, "!x|Zq|_9#|ab"))]
    plain = _pick(60, "the |and |so we saw |of |it was |with |in |a ")
    asks_mail, asks_host, asks_card, asks_phone = _pick(61, "write to |contact: |e-mail |my mail: "), _pick(62, "host |server |address |ip "), _pick(63, "card |visa |credit card: |amex |payment by "), _pick(64, "call |phone: |tel |fax |mobile ")
    against = _pick(65, "version |isbn |order |invoice |page |section |serial |ticket |part no. ")
    shas = _pick(66, "commit |sha |checksum |hash: |digest |uuid |id ")
    made = [(b, v, True) for v in mails for b in (asks_mail, asks_mail, plain)][:5]
    made += [(plain, _join(word, "' at '", _pick(5, "noon|home|school|night"), _pick(8, ".|. | ."), other), False)] * 3
    made += [(b, v, True) for v in (six, short) for b in (asks_host, plain)]
    made += [(plain, clock, False), (plain, mac, False), (asks_host, mac, False), (against, clock, False), (plain, _join(word, "'::'", name), False)]
    made += [(b, "LUHN", True) for b in (asks_card, asks_card, asks_card)] + [(b, v, False) for b in (plain, against, against) for v in (_join(card, _digits(16, 10)), "LUHN")] + [(plain, _join("'1'", _digits(17, 12)), False)] * 2
    made += [(b, v, True) for v in phone for b in (asks_phone, plain)]
    made += [(b, v, False) for v in numbers for b in (plain, against)]
    made += [(secret, v, True) for v in values] * 2
    made += [(secret, _pick(67, "required|nothing|forgotten|something|yesterday|optional"), False)] * 3
    made += [(b, v, False) for v in (values[0], values[1], _hex(58, 32), f"concat_ws('-', {_hex(51, 8)}, {_hex(52, 4)}, {_hex(53, 4)}, {_hex(54, 12)})") for b in (shas, plain)]
    return made


def sentences(spark: SparkSession, n: int = SENTENCES) -> DataFrame:
    """(id, text, first, last, span): one value each in a plain sentence, from code point `first` to `last`; span says whether it is personal or a look-alike."""
    makers = _makers()
    rows = spark.range(0, n, 1, 4).withColumn("maker", F.expr(f"CAST(pmod(xxhash64(id, 1), {len(makers)}) AS INT)"))
    payload = F.expr(_join(_pick(15, "3782 82|4539-12|511|6011 3"), _digits(16, 9)))
    check = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(payload, d.cast("string")))), 1)
    number = F.concat(payload, check.cast("string"))
    rows = rows.withColumns({"befores": F.array(*(F.expr(b) for b, _, _ in makers)), "values": F.array(*(number if v == "LUHN" else F.expr(v) for _, v, _ in makers)), "spans": F.array(*(F.lit(s) for _, _, s in makers))})
    before, value, span = (F.get(c, F.col("maker")) for c in ("befores", "values", "spans"))
    opening, closing = F.expr(_pick(70, "|Yes: |Then we came home. |As told before, |It rained all day and ")), F.expr(_pick(71, "| and so on.|. Then it went on.|, they said| (see there)|; here"))
    rows = rows.withColumns({"head": F.concat(opening, before), "value": value, "span": span})
    return rows.select("id", F.concat("head", "value", closing).alias("text"), F.length("head").alias("first"), (F.length("head") + F.length("value")).alias("last"), "span")


def _wide(rows: DataFrame) -> DataFrame:
    """Adds `base_spans`, the base candidates that pass their checks, and `wide`, the candidates of the wider generators that overlap none of them."""
    rows = rows.withColumn("base_spans", F.filter("candidates", lambda c: c["base"] & (c["valid"] == 1)))
    return rows.withColumn("wide", F.filter("candidates", lambda c: ~c["base"] & ~F.exists(F.col("base_spans"), lambda b: _overlaps(b, c))))


def fit(rows: DataFrame) -> Model:
    """Boosts over the counts of all wide candidates in rows of sentences(). Each fifth sentence only calibrates.

    A candidate counts as a span where it covers four fifths of one and doesn't reach beyond it by more than two code points.
    """
    places = rows.select(F.col("id").alias("own"), "first", "last", "span")
    found = _wide(candidates(rows, "id", "text")).join(places, F.col("id") == F.col("own"))
    each = found.select((F.col("id") % 5 == 0).alias("held"), "first", "last", "span", F.explode("wide").alias("c"))
    common = F.least(F.col("c.end"), F.col("last")) - F.greatest(F.col("c.start"), F.col("first"))
    label = F.col("span") & (common * 5 >= (F.col("last") - F.col("first")) * 4) & (F.col("c.start") >= F.col("first") - 2) & (F.col("c.end") <= F.col("last") + 2)
    each = each.select("held", label.alias("label"), "c.*")
    counts = each.groupBy("family", *FEATURES).agg(*(F.count_if((F.col("held") if held else ~F.col("held")) & (F.col("label") if good else ~F.col("label"))).alias(f"{'held_' * held}{'pos' if good else 'neg'}") for held in (False, True) for good in (True, False)))
    return boost([r.asDict() for r in counts.collect()])  # a row per cell of bins that occurs: SENTENCES at most


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model of the sentences; they are made by rule, so it is the same each time."""
    return fit(materialize(sentences(SparkSession.getActiveSession()), "sentences"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, base, added) of each row: arrays of (kind, start, end), in code points, end exclusive, by kind and start.

    base: the fixed patterns' matches that pass their checks. added: candidates of the wider generators whose
    score reaches their family's threshold; they overlap no base span, and of two that overlap the better
    stays (then the earlier). Null and empty texts have none; repeated rows each have a row; an empty
    table gives no rows; further columns aren't read. Without a model that of the sentences is taken.
    """
    model = model or default_model()
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    kind = F.array(*[F.lit(k) for k in ALL_KINDS])
    rows = _wide(found)
    least = F.array(*[F.lit(model.thresholds.get(k, math.inf)) for k in range(len(ALL_KINDS))])
    scored = F.transform("wide", lambda c: F.struct((-model.expression(c)).alias("cost"), c["start"].alias("start"), c["end"].alias("end"), c["family"].alias("family")))
    scored = F.array_sort(F.filter(scored, lambda c: -c["cost"] >= F.get(least, c["family"])))
    none = F.array().cast("array<struct<cost:double,start:int,end:int,family:int>>")
    kept = F.aggregate(scored, none, lambda s, c: F.when(F.exists(s, lambda o: _overlaps(o, c)), s).otherwise(F.array_append(s, c)))
    rows = rows.withColumn("kept", F.when(F.size("wide") > 0, kept).otherwise(none))

    def named(c: Column) -> Column:
        return F.struct(F.get(kind, c["family"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    added = F.transform(F.array_sort(F.transform("kept", lambda c: F.struct(c["family"].alias("family"), c["start"].alias("start"), c["end"].alias("end")))), named)
    return rows.select(F.col("id").alias(id_col), F.transform("base_spans", named).alias("base"), added.alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_redacted): the texts with every span of detect() replaced by its kind in brackets. Needs unique ids; null texts stay null."""
    spans = detect(docs, id_col, text_col).select(F.col(id_col).alias("span_id"), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        skip = F.greatest(s["at"], c["end"])
        gap = F.substring(text, s["at"] + 1, F.greatest(c["start"] - s["at"], F.lit(0)))
        return F.struct(skip.alias("at"), F.when(c["end"] <= s["at"], s["out"]).otherwise(F.concat(s["out"], gap, F.lit("["), F.upper(c["kind"]), F.lit("]"))).alias("out"))

    done = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    joined = docs.join(spans, docs[id_col] == F.col("span_id"), "left")
    return joined.select(docs[id_col], F.when(F.col(text_col).isNotNull(), F.coalesce(done, text)).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_redacted"))
