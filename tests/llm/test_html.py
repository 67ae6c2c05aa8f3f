"""Operator 6 on hand-made pages and on the given ones."""

from __future__ import annotations

import re
from html import unescape

from keystrata.llm import html_extraction as H

PROSE = "The ship of the line was on the way to the coast, and it is not known that any of the men were lost in the storm."


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body class="nav-open">
    <header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies and the like on this site.</div>
    <article><header><h1>The   Title</h1></header><p>{PROSE}<br>Next line.</p><p>Short.</p><div class="ad">Buy the best of the best and be happy.</div>
    <p>AT&amp;T &lt;b&gt; caf&eacute;&nbsp;&#x41; <script>var t="</p>";</script>end</p><ul><li>one</li><li>two</li></ul>
    <form><label>Mail</label><input></form><section id="comments"><p>{PROSE} I think.</p></section><footer>By someone</footer></article>
    <aside>{PROSE}</aside><footer>&copy; all</footer><!-- <p>{PROSE}</p> --></body></html>"""
    assert H.main_text(page).split("\n") == ["The Title", f"{PROSE} Next line.", "Short.", "AT&T <b> café A end", "one", "two"]


def test_values_of_other_attributes_and_parts_of_names_drop_nothing():
    harmless = ['style="overflow:hidden"', 'title="The hidden valley"', "title='class=ad'", 'href="/p?id=ad"', "href=/hidden/path?id=ad", 'data-class="ad"', 'class="content overflow-hidden"', 'class="post comments-open"', 'class="search-term"', 'aria-hidden="false"', 'title="hidden']
    for attributes in harmless:
        assert H.main_text(f"<article><p>{PROSE}</p><div {attributes}>{PROSE} Kept.</div></article>") == f"{PROSE}\n{PROSE} Kept.", attributes
        assert H.main_text(f"<article><p>On <a {attributes}>an isle</a> {PROSE}</p></article>") == f"On an isle {PROSE}", attributes
    for attributes in ("hidden", 'hidden=""', 'HIDDEN class="content"', 'aria-hidden="true"', 'class="x ad"', "id=comments", "role='search'", 'class="cookie-notice"', 'class="adBanner"', 'class="ad-container"', 'class="sidebar-left"', 'class="comment-list"'):
        assert H.main_text(f"<article><p>{PROSE}</p><div {attributes}>{PROSE} Gone.</div></article>") == PROSE, attributes


def test_page_without_article():
    page = f"""<body><div class="menu"><a href=a>A</a></div><div><a href=b>Only</a> <a href=c>links here</a></div><h2>Heading</h2><p>{PROSE} {PROSE}</p><p>Brief.</p><p>{PROSE} {PROSE}</p>
    <p>x1 k2 z3 {'q' * 80}</p><p>Copyright</p></body>"""
    assert H.main_text(page).split("\n") == ["Heading", f"{PROSE} {PROSE}", "Brief.", f"{PROSE} {PROSE}"]


def test_broken_and_empty_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    assert H.main_text(f"<article><p><b>{PROSE}<br><p>{PROSE}</p><p>cut &am") == f"{PROSE}\n{PROSE}\ncut &am"
    assert H.main_text(f"<article><p>{PROSE}</p><p title='a>b'>more of it</p></artic") == f"{PROSE}\nmore of it"
    assert H.main_text("<article><p>1 < 2 & 3 > 2</p><script>never closed") == "1 < 2 & 3 > 2"
    assert H.main_text("<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "</article>") == "deep"
    assert len(H.main_text("<article><p>" + "word " * 200000)) == 999999


def test_neighbours_decide_short_blocks():
    good, bad = (PROSE * 2, False, 0.0, False), ("link", False, 0.9, False)
    short, heading = ("short", False, 0.0, False), ("Short", False, 0.0, True)
    assert H.labels_of([good, short, short, bad, short]) == [True, True, False, False, False]
    assert H.labels_of([good, short, bad, heading, good]) == [True, False, False, True, True]
    assert H.labels_of([short]) == [False] and H.labels_of([("short", True, 0.0, False)]) == [True]
    assert H.labels_of([good, ("a teaser", True, 0.0, False), bad]) == [True, False, False]
    assert H.labels_of([]) == []


def test_articles_lose_nothing():
    long = PROSE * 3
    assert H.main_text(f"<div>Outside text</div><article><p>Short one.</p><p>Short two.</p><p>{long}</p></article>").split("\n") == ["Short one.", "Short two.", long]
    assert H.main_text(f"<article><p>{long}</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><p>Fin.</p></article>").split("\n") == [long, "One", "Two", "Fin."]
    assert H.main_text(f"<article><p>{long}</p><p class='share price'>The share fell.</p></article>").split("\n") == [long, "The share fell."]
    assert H.main_text(f"<article><p>{long}</p><p class='share'>Share this</p><div class='tags'>a b</div></article>") == long
    assert H.main_text(f"<article><p>{long}</p><p>Let <math><mi>x</mi> = <mn>2</mn></math> be.</p></article>").split("\n") == [long, "Let x = 2 be."]


def test_reader_comments_go():
    for tag in ("article class='comment'", "article class='comment-body'", "div class='comment-content'", "section id=comments", "li class='comment even'"):
        name = tag.split()[0]
        assert H.main_text(f"<article><p>{PROSE}</p><{tag}><p>{PROSE} I think.</p></{name}></article>") == PROSE, tag


def test_prose_outside_of_teasers():
    page = f"<article class='teaser'><p>Read more</p></article><div>{PROSE * 3}</div><div>{PROSE * 3}</div><div><a href=a>Next page of it</a></div>"
    assert H.main_text(page).split("\n") == ["Read more", PROSE * 3, PROSE * 3]


def test_columns(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "<article>a</article>", None)], "page_id bigint, html string, Main_Text string")
    got = H.extract_main_text(pages)
    assert sorted(map(str, (r.main_text_ for r in got.collect()))) == ["", "", "a"]
    assert H.extract_main_text(pages.limit(0)).count() == 0


def test_op6(spark, sf_dir):
    """Pages of the test tables hold one article each: its blocks are what stands between the tags."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in H.op6_html_extraction(spark, sf_dir).collect():
        inner = re.search("(?s)<article>(.*?)(</article>|$)", html.pop(r.page_id))[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>?", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert not html
