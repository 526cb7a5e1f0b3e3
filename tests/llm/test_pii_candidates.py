"""The wider generators propose the same spans whatever else the text holds."""

from lodestone.llm import pii

MAILS = ["ann at mail (dot) org", "ann at mail [dot] org", "ann at mail.org", "ann at mail dot org", "ann (at) mail.org", "ann [AT] mail (DOT) org"]
SIXES = ["2001:db8::1", "fe80::1:2:3", "::1", "2001:db8:0:1:2:3:4:5"]


def valid(spark, texts, family):
    df = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    return {r.id: [texts[r.id][c.start : c.end] for c in r.candidates if c.family == family and c.valid == 1 and not c.base] for r in df.collect()}


def test_gates_let_through_all_that_patterns_take(spark):
    texts = [f"<{m}>" for m in MAILS] + [f"<{m}> and elsewhere (at) dot" for m in MAILS] + ["We were at home. Then we left."]
    assert valid(spark, texts, 0) == {i: [m] for i, m in enumerate(MAILS + MAILS)} | {len(texts) - 1: []}


def test_compressed_addresses(spark):
    texts = [f"host <{x}> here" for x in SIXES] + ["std::move and 12:30:15 and Foo::bar"]
    assert valid(spark, texts, 1) == {i: [x] for i, x in enumerate(SIXES)} | {len(SIXES): []}
