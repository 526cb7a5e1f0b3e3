"""What the trees add to the base spans: planted values in sentences and forms that they weren't fitted on, and look-alikes."""

from lodestone.llm import pii

SPANS = {
    "email": ["jo (at) garden-shop (dot) net", "mary_w [at] letters [dot] org", "peter(at)fishes.com", "k.stone (AT) north (dot) de", "lou [at] mill.info"],
    "ip": ["2001:db8:85a3:1:2:8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "2a02:26f0::5", "2001:470:1f0b::2:7"],
    "card": ["3714 496353 98431", "378282246310005", "30569309025904"],
    "phone": ["(030) 901 8200", "0221 4710 123", "0049 89 636 48018", "020 7946 0958", "0171-555-0199", "(0711) 216-4400"],
    "secret": ["5d41402abc4b2a76b9719d911017c592", "hunter2-Alpha", "c2VjcmV0LXZhbHVlLTEyMw==", "AKX99Z-77ab-Q1"],
}
LEAD = {"email": "Please send it to", "ip": "We pinged the server", "card": "She paid by credit card:", "phone": "You may phone", "secret": "The new password is"}
LOOK_ALIKES = [
    "We met at noon. There was rain.", "They were at home. It was late.", "The train at platform. Seven left.", "The race took 01:22:33:04:05 in all.", "Its label is 00:1b:44:11:3a:b7 as ever.",
    "On 2021-03-14 we left.", "It was 14.03.2021 then.", "See version 10.15.7 22 of it.", "The isbn 978-3-16-148410 is known.", "Invoice 1234567890123 is open.", "Ticket 4716 123 456 is done.", "Around 45 893 942 people came.",
    "commit 9c8b45435718dcc700c184a7e303cdc64c6a8f7f fixed it.", "The checksum 5d41402abc4b2a76b9719d911017c592 holds.", "Password: required by all.", "The secret is something else.", "Use std::move and Foo::bar here.",
]


def added(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.detect(df).collect()}


def test_recall_and_precision_of_added_spans(spark):
    planted = [(kind, value) for kind, values in SPANS.items() for value in values]
    texts = [f"{LEAD[kind]} {value} before the end of May." for kind, value in planted] + LOOK_ALIKES
    got = added(spark, texts)
    right = sum(planted[i] in got[i] for i in range(len(planted)))
    every = sum(map(len, got.values()))
    assert right >= 0.9 * len(planted), [(p, got[i]) for i, p in enumerate(planted) if p not in got[i]]
    assert every - right <= 0.1 * every, {texts[i]: s for i, s in got.items() if i >= len(planted) and s}


def test_check_is_no_gate_and_base_spans_stay(spark):
    """A card number with a wrong checksum is a candidate of the trees; base spans are the same whatever the model says."""
    texts = ["credit card: 3714 496353 98432 soon", "mail ann@mail.org or call +1 415 555 0199", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df, "doc_id", "text").collect()
    assert any(c.valid == 0 and not c.base for c in found[0].candidates)
    base = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.detect(df, model=pii.Model()).collect()}
    assert base == {0: [], 1: [("email", 5, 17), ("phone", 26, 41)], 2: [], 3: []}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail ann@mail.org, token = \"cf1d64a9a4cd9723e1f4eafc27395915e6868ffa\" here"), (2, None), (3, "plain")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_redacted) for r in pii.redact(df).collect()} == {1: ('mail [EMAIL], token = "[SECRET]" here', 2), 2: (None, 0), 3: ("plain", 0)}
