"""Hand-written pages, and the awkward rows of the query of pages."""

import pytest
from pyspark.sql import functions as F

from porelight.llm import html_blocks, html_crf

LONG = "A first paragraph of the text that says something of the matter at hand, at some length."
MORE = "And a second one that goes on with it, as long as the first one was, to the very end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>x</title><p>{LONG}</p><p>{MORE}</p></html>", f"{LONG} {MORE}"),  # a head that is never closed
        (f"<html><head><title>x</title><style>p{{}}</style><meta charset=u><body><p>{LONG}</p><p>{MORE}</p>", f"{LONG} {MORE}"),
        ("<html><body><article><p>Before the picture.</p></article></body></html>", "Before the picture."),
        (f"<body><article><p>{LONG}</p><svg><text>no</text></svg><p>{MORE}</p></article>", f"{LONG} {MORE}"),
        (f"<body><article><p>{LONG}</p><svg><path d=1><p>{MORE}</p></article>", f"{LONG} {MORE}"),  # a paragraph ends a picture
        (f"<body><article><p>{LONG}</p><canvas><p>{MORE}</p></article>", f"{LONG} {MORE}"),  # never closed
        (f"<body><article><p>{LONG}</p><select><option>one</option></select><p>{MORE}</p></article>", f"{LONG} {MORE}"),
        (f"<body><article><p>a &lt;b&gt; &amp;  c&nbsp;d {LONG}</p></article>", f"a <b> & c d {LONG}"),
        ("<script>var x = 'text';</script>", ""),
        ("", ""),
    ],
)
def test_pages(page, text):
    assert html_crf.main_text(page, html_crf.fitted()) == text


def test_features_read_whole_blocks():
    """What a block says is a rate over all its words, wherever they stand."""
    feature = html_blocks.INDEX["says:cookie"]
    of = lambda text: html_blocks.leaf_blocks(f"<p>{text}</p>")[0].features
    filler = "word " * 80
    assert feature in of(filler + "cookie " * 20) and feature in of("cookie " * 20 + filler)
    assert feature not in of("cookie " + filler) and feature not in of(filler + "cookie")
    digits = html_blocks.INDEX["digits"]
    assert digits in of("word " * 60 + "12345678 " * 60) and digits not in of("12345678 " * 5 + "word " * 200)


def test_awkward_rows(spark):
    long = "<body><article>" + f"<p>{LONG}</p>" * 4000 + "</article></body>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<article><p>{LONG}</p></article>"), (3, "u", f"<article><p>{LONG}</p></article>"), (None, "u", "<p>"), (4, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "id")})
    for df in (pages, pages.limit(0)):
        out = html_crf.extract(df, carry=("url",)).select("page_id", "url", "text", "n_chars").collect()
        assert len(out) == df.count()
        by = {}
        for r in out:
            by.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
        if out:
            assert by[1] == [("u", "", 0)] and by[2] == [(None, "", 0)] and by[None] == [("u", "", 0)]
            assert by[3] == [("u", LONG, len(LONG))] * 2 and by[4] == [("v", " ".join([LONG] * 4000), 4000 * len(LONG) + 3999)]
