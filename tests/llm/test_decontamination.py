"""Decontamination on items and documents made for it."""

import pytest

from lodestone.llm import decontamination

HEAVY = ["What is 12 + 30?", "Compute 12 km", "Compute the 12 km distance", "Anna, Bert, Carl, Dora, Emil, Fritz", "1.5 2.5 3.5 4.5 5.5 6.5 7.5", "km 12 34"]


def tables(spark, items, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


@pytest.mark.parametrize("before", ["", "please answer this: ", "she said ", "of 5 "])
def test_copies_of_placeholder_heavy_items(spark, before):
    """A verbatim copy of every item is found, whatever stands before it; the same template with other numbers isn't one."""
    docs = {k: f"{before}{item} and then we go on with plain words" for k, item in enumerate(HEAVY)}
    docs |= {10: f"{before}What is 13 + 31? and then", 11: f"{before}1.5 2.5 3.6 4.5 5.6 6.5 7.6 and then", 12: "nothing of the kind in here"}
    assert pairs(decontamination.contaminated(*tables(spark, HEAVY, docs))) == {(k, k) for k in range(len(HEAVY))}


def test_other_numbers_are_still_found(spark):
    """Items that have windows of plain words are found with other values as before."""
    item = "a train leaves the old station at 12 and covers 30 km in the first hour of the trip"
    docs = {1: item, 2: item.replace("12", "17").replace("30", "44")}
    assert pairs(decontamination.contaminated(*tables(spark, [item], docs))) == {(1, 0), (2, 0)}


def test_each_alignment_is_judged_alone(spark):
    """A consistent copy is found though other text on its template is not consistent; pieces of several places don't make up one copy; an edited copy is one."""
    item = "the shop sold 12 red apples to the first guest and again 12 green apples to the second guest today"
    other = item.replace("12 red", "15 red").replace("12 green", "99 green")
    cut = item.split()
    docs = {
        1: f"{other} . so we saw . {item}", 2: other, 3: " ".join([*cut[:8], *["word"] * 60, *cut[12:]]), 4: " ".join([*cut[:10], "very", *cut[10:]]),
    }
    assert pairs(decontamination.contaminated(*tables(spark, [item], docs))) == {(1, 0), (4, 0)}


def test_rows_without_id_are_kept_or_go_by_their_text(spark):
    item = "which of the many rivers of this land is known to be the longest one"
    docs = spark.createDataFrame([(1, f"so {item} then"), (2, "plain words of nobody"), (None, f"again {item} then"), (None, "other plain words"), (None, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == [(0, ""), (0, "other plain words"), (2, "plain words of nobody")]


def test_pipeline_stage_drops_copies_without_id(spark):
    import corpus_pipeline
    from conftest import SF
    from lodestone.llm.common import table

    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    docs = spark.createDataFrame([(None, f"so it is: {item}"), (None, "plain words of nobody")], "doc_id long, text string")
    assert [r.text for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()] == ["plain words of nobody"]
