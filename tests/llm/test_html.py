"""HTML extraction: what the minimum cut changes, malformed and odd pages."""

import os
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.llm import html

LONG = "The river runs past the stone house. It turns at the market and goes on to the sea, as it did in the year before. Boats wait there."
DATA = "/root/testdata/sf0.001/pages.parquet"


def test_neighbours_outvote_a_weak_block():
    """Without any mark, a short line among long ones is content and a word among links is not: their own signs say otherwise."""
    page = "<div>" + "".join(f"<div>{t}</div>" for t in (LONG, "So it goes on", LONG, LONG)) + "</div><div>" + "".join(f"<span><div><a href=x>{t}</a></div></span>" for t in ("Home", "News", "Shop")) + "<div>Mail and more pages of text, in short. Yes. Go.</div>" + "".join(f"<div><a href=x>{t}</a></div>" for t in ("Log", "Map")) + "</div>"
    got = html.extract(page, html.PRIOR)
    assert [t for t, keep, _ in got if keep] == [LONG, "So it goes on", LONG, LONG]
    flipped = [t for t, keep, z in got if keep != (z > 0)]
    assert "So it goes on" in flipped and any(t.startswith("Mail") for t in flipped)


def test_marks_are_bounded_and_can_be_outvoted():
    """A wrong mark inside an article, on a block whose text and neighbours speak for it, gives way; a marked notice does not."""
    w = html.fit([f"<nav><a>x</a><a>y</a></nav><article><p>{LONG}</p></article><footer>c</footer>"] * 20)
    k = html.TEXTUAL
    assert html.MOST_BOILER / 2 <= -w[k] <= html.MOST_BOILER and html.MOST_CONTENT / 2 <= w[k + 1] <= html.MOST_CONTENT
    page = f"<article><h1>Title of it</h1><p>{LONG}</p><div class='ad'>Buy now.</div><p>{LONG}</p></article>"
    assert "Buy now" not in " ".join(t for t, keep, _ in html.extract(page, w) if keep)


@pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables are not here")
def test_stripped_pages():
    """Pages with their article, nav, footer and class marks taken off: the cut changes labels, and makes fewer faults than signs."""
    pages = list(pd.read_parquet(DATA).html)
    w, signs, cut, changed = html.fit(pages), 0, 0, 0
    for p in pages:
        plain = html.extract(re.sub(r"(</?)(article|nav|footer)\b", r"\1div", p).replace(' class="ad"', ""), w)
        marked = html.extract(p, w)
        assert len(plain) == len(marked)
        for (_, keep, z), (_, right, _) in zip(plain, marked):
            signs, cut, changed = signs + ((z > 0) != right), cut + (keep != right), changed + (keep != (z > 0))
    assert changed > 0 and cut <= signs


def test_malformed_pages_take_time_in_proportion():
    for unit in ("<aaa", '<a "', "<", "<!--", "<a x='\">", "<option>", "<b></i>", "<section><li></li>", "</option", "<p>a", "<td><i>"):
        began = time.time()
        html.extract((unit * 1_000_000)[:1_000_000], html.PRIOR)
        assert time.time() - began < 20, unit


def test_quotes():
    text = lambda p: " ".join(t for t, *_ in html.extract(p, html.PRIOR))
    assert text("<p title='a>b'>one</p>") == "one" and text("<p title=it's>one</p><p>two</p>") == "one two"
    assert text('<p title="x>one</p><p>two</p>') == "one two" and text("a < b and c > d") == "a < b and c > d"
    assert text("<p>one<!-- two > <p>three") == "one" and text("<p>&lt;b&gt; &amp;amp;</p>") == "<b> &amp;"


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, f"<article><p>{LONG}</p></article>", "t", 9), (1, f"<article><p>{LONG}</p></article>", "t", 9), (2, None, "t", 9), (None, "", "t", 9)], "page_id long, html string, text string, k int").withColumn("_hash", F.lit(1))
    out = html.main_text(d, html.train(d))
    assert out.columns == d.columns
    assert sorted((r["page_id"] or 0, r["text"]) for r in out.collect()) == [(0, ""), (1, LONG), (1, LONG), (2, "")]
    assert html.main_text(d.limit(0), html.train(d.limit(0))).count() == 0
