"""PartEnum's promise on random sets, and the join in groups larger than a block."""

import numpy as np
import pytest

from lodestone.llm import jaccard_join, partenum


def at_the_limit(rng, size, percent):
    """Two sets of 64-bit elements, as different as the similarity allows."""
    base = np.unique(rng.integers(0, 2**63, size=size, dtype=np.uint64))
    gone, new = int(rng.integers(0, size // 2 + 1)), int(rng.integers(0, size // 2 + 1))
    while 100 * (len(base) - gone) < percent * (len(base) + new):
        if new and (rng.random() < 0.5 or not gone):
            new -= 1
        else:
            gone -= 1
    return base, np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**63, size=new, dtype=np.uint64)])


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_signature_and_no_sketch_rules_them_out(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 90, 133, 200, 400, 900]:
        for _ in range(6):
            a, b = at_the_limit(rng, size, percent)
            both, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
            sig, owner = partenum.signatures(both, sizes, percent)
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), size
            rows = partenum.sketches(both, sizes, percent)
            words = min(map(len, rows)) // 8
            assert partenum.possible(partenum.fold(rows[0], words)[None], partenum.fold(rows[1], words)[None], sizes[:1], sizes[1:], percent)[0][0]


def test_levels_enumerate_subsets_by_band():
    assert [x.tolist() for x in partenum.levels(85, np.array([3, 20, 2000]))] == [[1, 2, 362], [0, 1, 0]]


def brute(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        words = t.lower().split()
        sets[d] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in sets}


def test_groups_larger_than_a_block(spark, monkeypatch):
    """Near copies, sets just below the threshold and strangers that share groups: blocks of four sets, two partners at first."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "NEAREST", 2)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(90):
        words = list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, 60))] = f"x{int(rng.integers(0, 40))}"
        texts[d] = " ".join(words if d % 3 else words[:30])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 3, 80).collect()} == brute(texts, 3, 80)


def test_rows_without_id(spark):
    text, near = " ".join(f"a{i}" for i in range(60)), " ".join([*(f"a{i}" for i in range(59)), "z"])
    other = " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(None, text, 1), (4, near, 2), (None, other, 3), (None, other, 4), (None, None, 5), (7, "", 6)], "doc_id long, text string, comp int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(0, 0, 0), (0, 36, 0), (0, 36, 0), (0, 56, 4), (4, 56, 4), (7, 0, 7)]
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.comp if r.comp not in (3, 4) else 34 for r in kept.collect()) == [2, 5, 6, 34]
