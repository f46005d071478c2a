import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import main_text
from tessera.llm.main_text import main_text as extract

LONG = "This is what we said about the house and the garden, and it was more than they had asked for when it all began in the long summer of that year. "
FOLDER = "/root/testdata/sf0.01"


def plain(page):
    """Independent of the operator: what stands between the article tags of the generated pages."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    inner = re.sub(r"<[^>]*\Z", "", inner).replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query_on_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = main_text.op12_main_text(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: r.text for r in rows} == {i: plain(p) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("outside", [
    "<nav><ul><li><a href='/a'>Menu of the day and all that</a></ul></nav>", f"<header><p>{LONG}</p></header>", f"<footer>&copy; {LONG}</footer>", f"<aside><p>{LONG * 2}</p></aside>",
    f"<div class='cookie-notice'><p>{LONG}</p></div>", f"<div id=adBox>{LONG}</div>", f"<form><label>Name</label><p>{LONG}</p><input></form>", f"<script>if (a < b) '</p>{LONG}'</script>",
    f"<style>p > a {{}} {LONG}</style>", f"<section id='comments'><article class='comment'><p>{LONG}</p></article></section>", f"<!-- {LONG} <p> -->", f"<noscript>{LONG}</noscript>",
    f"<div class='related'><article><p>{LONG}</p></article></div>", f"<div role=\"complementary\" data-x='>'><p>{LONG}</p></div>", "<p>Short one</p>", f"<template><p>{LONG}</p></template>",
])
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main class='has-sidebar'><div>{}</div></main>", "<div class=content>{}</div>"])
def test_what_is_dropped(outside, inside):
    body = inside.format(f"<h1>A title</h1><p>{LONG}<p>So it is.</p><p>{LONG} &amp; more</p>")
    want = f"A title\n{LONG.strip()}\nSo it is.\n{LONG}& more"
    for page in (outside + body, body + outside, outside + body + outside):
        assert extract(f"<!doctype html><html><head><title>x</title></head><body>{page}</body></html>") == want


def test_scopes():
    inner = f"<article><header><h1>Title</h1></header><p>12 34 56</p><pre>x = 1;\n  y = 2;</pre><p>{LONG}</p><div class=share><a>Tweet</a></div><footer>Filed under</footer></article>"
    assert extract(f"<form id=page>{inner}</form>") == f"Title\n12 34 56\nx = 1; y = 2;\n{LONG.strip()}"  # a form around the page is no form
    assert extract("<article><h1>Only</h1><p>few words</p></article>") == "Only\nfew words"
    assert extract("<div><h1>Only</h1><p>few words</p></div>") == ""
    assert extract(f"<article><p>teaser</p></article><div><p>{LONG * 3}</p></div>") == "teaser\n" + (LONG * 3).strip()
    links = "".join(f"<li><a href='/{i}'>where it is that we are going to {i}</a>" for i in range(9))
    assert extract(f"<div><ul>{links}</ul><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><ul>{links}</ul></div>") == f"{LONG.strip()}\nYes.\n{LONG.strip()}"


def test_characters():
    assert extract(f"<article><p>{LONG}&nbsp;&eacute;&#x41;&#66;&am <b>b</b>old<br>new\tline<br> <br/>block &lt;p&gt; 1 < 2 <3") == f"{LONG}éAB&am bold new line\nblock <p> 1 < 2 <3"
    for tail in ("<", "<p", "</arti", "<!-- x", "<a href='x", "&am", "<scrip", "<script>x", "</"):
        assert extract(f"<article><p>{LONG}{tail}").startswith(LONG.strip())
    assert extract(None) == extract("") == extract("<article></article>") == extract(" \n ") == ""


def test_long_and_broken_pages_take_linear_time():
    rng = random.Random(2)
    pieces = ["<div>", "</div>", "<li>", "<a ", "'", '"', "=", "<!--", "<p>", "word ", ">", "</li>", "<article>", "</article>", "&", "<script", "<ul class=ad>"]
    for page in ("<a '" * 300_000, "<!-" * 300_000, "<div>" * 200_000 + "<li></li>" * 50_000, "<" * 500_000, "<p>a" * 200_000, "".join(rng.choices(pieces, k=300_000)), f"<article>{LONG * 20_000}</article>"):
        began = time.perf_counter()
        extract(page)
        assert time.perf_counter() - began < 20


def test_awkward_rows(spark):
    rows = [(1, None, "a", "t"), (1, None, "a", "t"), (None, "", None, None), (2, f"<main><p>{LONG}</main>", "b", "u")]
    frame = spark.createDataFrame(rows, "page_id bigint, html string, url string, text_ string")
    found = main_text.extracted(frame).select("page_id", "text", F.length("text").alias("n")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, "", 0), (1, "", 0), (None, "", 0), (2, LONG.strip(), len(LONG.strip()))], key=str)
    assert main_text.extracted(frame.limit(0)).count() == 0
