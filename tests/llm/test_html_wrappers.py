"""HTML extraction on hosts made for it: what the wrapper can tell apart, and that copies and partitions don't matter."""

from lodestone.llm import html_wrappers


def site(spark, bodies, parts=1, host="a.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(parts)


def articles(df):
    return {r.page_id: r.text.split("\n\n") if r.text else [] for r in html_wrappers.extract_pages(df).collect()}


def words(i, k):
    return f"Text {k} of page {i} says what only this page says, in {i * 7 + k} words."


def test_wrapper_tells_adverts_from_article(spark):
    """Inside <article>: a fixed block of a plain class goes, text that varies stays though its class is on the list of words."""
    bodies = [f'<nav><a href="/">Home</a></nav><article><h1>{words(i, 0)}</h1><p>{words(i, 1)}</p><div class="x9"><p>Buy our shoes today.</p></div><p class="notice">{words(i, 2)}</p><h2>Sources</h2><p>{words(i, 3)}</p></article>' for i in range(6)]
    got = articles(site(spark, bodies))
    assert got == {i: [words(i, 0), words(i, 1), words(i, 2), "Sources", words(i, 3)] for i in range(6)}


def test_template_goes_by_place(spark):
    """Without marks: a closing paragraph that never changes takes no other paragraph along; headings and lists stay."""
    bodies = [
        f'<div class="top"><p>Welcome to this site.</p></div><div class="content"><p>{words(i, 0)}</p><p>{words(i, 1)}</p><h2>{words(i, 2)}</h2><p>{words(i, 3)}</p><ul><li>{words(i, 4)}</li></ul><p>Thanks for reading.</p></div><div class="end"><p>All rights reserved.</p></div>'
        for i in range(6)
    ]
    got = articles(site(spark, bodies))
    assert got == {i: [*(words(i, k) for k in range(5)), "Thanks for reading."] for i in range(6)}


def test_container_is_no_paragraph(spark):
    """Where paragraphs hold nearly all of the varying text, the rest of the article still is its part."""
    bodies = [f'<div class="top"><p>Welcome to this site.</p></div><div class="content"><h2>Part {i}</h2>{"".join(f"<p>{words(i, k)}</p>" for k in range(8))}<blockquote>Said {i}</blockquote><p>Thanks for reading.</p></div>' for i in range(6)]
    got = articles(site(spark, bodies))
    assert got == {i: [f"Part {i}", *(words(i, k) for k in range(8)), f"Said {i}", "Thanks for reading."] for i in range(6)}


def test_copies_and_partitions_teach_nothing(spark):
    """One page copied into many partitions counts once: what only it has isn't template, and each partitioning gives the same wrapper."""
    bodies = [f'<div class="content"><p>{words(i, 0)}</p><p>{words(i, 1)}</p></div>' for i in range(5)]
    odd = f'<div class="content"><p>{words(9, 0)}</p><div class="more">{words(9, 1)}</div></div>'
    pages = site(spark, [*bodies, *[odd] * 12])
    seen = set()
    for parts in (1, 4, 17):
        dealt = pages.repartition(parts)
        (wrapper,) = html_wrappers.infer_wrappers(dealt).collect()
        assert wrapper.pages == 6
        seen.add(wrapper.wrapper)
        got = articles(dealt)
        assert all(got[i] == [words(9, 0), words(9, 1)] for i in range(5, 17)) and all(got[i] == [words(i, 0), words(i, 1)] for i in range(5))
    assert len(seen) == 1


def test_empty_pages_and_no_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://b.example/", "<p>Only words.</p>")], "page_id long, url string, html string")
    assert articles(df) == {1: [], 2: [], 3: ["Only words."]}
    assert html_wrappers.extract_pages(df.limit(0)).count() == 0
