"""The operators against plain Python, and on rows that are null, empty, repeated or have clashing columns."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import decontamination, id_files, jaccard_join, mixing, pii, quality, queries, sharding, tiff, token_counts
from lodestone.llm.common import scratch, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "", r.source) for r in table(spark, SF, "documents").collect()}


def rows(df):
    return {r[0]: r for r in df.collect()}


def odd(spark):
    """Nulls, empty and blank texts, copies, repeated rows, one long text and columns whose names clash."""
    data = [(1, None, "a"), (2, "", None), (3, "  \n", "a"), (4, "one two three four five six", "b"), (5, "one two three four five six", "b"), (5, "one two three four five six", "b"),
            (6, "x " * 60_000, "a"), (7, "mail me at ann@mail.org or +1 415 555 0199", None), (None, "no id here", "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("k", "size", "shard", "n_tokens", "sig", "score", "lang")})


def test_jaccard_brute_force(spark, texts):
    def shingles(text):
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()

    sets = {d: shingles(t) for d, (t, _) in texts.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = rows(queries.op3_jaccard_join(spark, SF))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(s), find(d)) for d, s in sets.items()}


def test_id_files_brute_force(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    got, start = rows(queries.op2_id_files(spark, SF)), 0
    for d in sorted(texts):
        ids = tok.encode(texts[d][0], add_special_tokens=False).ids + [2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_token_counts_brute_force(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(queries.op9_token_counts(spark, SF))
    for d, (text, _) in texts.items():
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(text.encode()), n, n > 512)


def test_tiff_round_trip(spark, texts):
    got = rows(queries.op8_tiff(spark, SF))
    for d, (text, _) in texts.items():
        data = text.encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii_base_spans(spark, texts):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    got = rows(queries.op1_pii(spark, SF))
    for d, (text, _) in texts.items():
        spans = [(k, m.start(), m.end()) for k, (pattern, good) in rules.items() for m in re.finditer(pattern, text) if good(m[0])]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), d
        assert [got[d][f"n_{k}"] for k in rules] == [sum(s[0] == k for s in spans) for k in rules]
        assert set(filter(None, written.split(","))) <= set(got[d].spans.split(","))


def test_shards(spark, texts):
    got = rows(queries.op4_sharding(spark, SF))
    shard_of, slots = {}, {}
    for d, (text, _) in texts.items():
        r = got[d]
        assert r["size"] == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and 0 <= r.shard < 40
        assert shard_of.setdefault(text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix(spark, texts):
    got = rows(queries.op5_mixing(spark, SF))
    taken, target, size = {}, {}, {}
    for d, (text, source) in texts.items():
        r = got[d]
        assert r["size"] == len(WORD.findall(text.encode())) and 0 <= r.taken <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
        size[source] = size.get(source, 0) + r["size"]
        target[source] = r.target
    assert all(t <= 3 * size[s] + 1e-6 for s, t in target.items())
    assert all(abs(taken[s] - t) <= max(50, 0.02 * t) for s, t in target.items())
    assert got == rows(queries.op5_mixing(spark, SF))


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = rows(queries.op7_quality(spark, SF))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    tried = [(got[d].predicted, q) for d, q in labels.items() if got[d].held_out]
    assert sum(p == q for p, q in tried) >= 0.75 * len(tried)


def test_decontamination_catches_items(spark):
    bench = table(spark, SF, "benchmark")
    item = bench.first().text
    docs = spark.createDataFrame([(1, "Some words before it. " + item + " And some after."), (2, "a plain clean text of nobody " * 9), (3, None), (4, "")], "doc_id long, text string").withColumn("item_id", F.lit(9))
    assert 1 in (found := rows(decontamination.contaminated(docs, bench))) and not {2, 3, 4} & set(found)
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, bench).collect()) == [2, 3, 4]


def test_odd_rows(spark):
    docs, labels = odd(spark), table(spark, SF, "labels")
    path = scratch(spark, "odd")
    id_files.write_ids(docs, path, "word_bpe_49k.json", 2)
    assert id_files.read_ids(spark, path, with_ids=False).count() == 9
    found = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert sharding.shard(docs, 3).count() == mixing.mix(docs).count() == pii.detect(docs).count() == 9
    assert quality.score(docs, labels, threshold=0.3).count() == 9
    assert token_counts.count_tokens(docs, "byte_bpe_50k.json", 512).count() == tiff.media_digest(tiff.texts_to_tiff(docs)).count() == 9


def test_empty_tables(spark):
    docs = odd(spark).limit(0)
    for df in (jaccard_join.jaccard_components(docs), sharding.shard(docs, 3), mixing.mix(docs), pii.detect(docs), decontamination.contaminated(docs, table(spark, SF, "benchmark")),
               token_counts.count_tokens(docs, "byte_bpe_50k.json", 512), quality.score(docs, table(spark, SF, "labels"), threshold=0.3)):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = table(spark, SF, "documents")
    for _, stage in p.STAGES[:4]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns
        path = scratch(spark, "stage")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    assert p.run(spark, SF).count() == docs.count()
