from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from siltstone.llm.html_text import extract, main_text

P1 = "The first paragraph has enough words, commas, and sense to be scored as text."
LINKS = '<ul><li><a href="/x">One link here</a></li><li><a href="/y">Another link here</a></li></ul>'
P2 = "A second one follows, it is long enough as well, and it has no links in it."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head>
    <body class="with-sidebar"><div id="cookie-notice">We use cookies, really, many of them, on every page you see.</div>
    <header><h1>Site</h1><p>Site slogan, which is long, and has commas, in it.</p></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- ad <p>x</p> -->
    <div class=ad>Buy now, cheap, fast, good, and long enough to score as a paragraph.</div>
    <article><h1>Title &amp; more</h1><p><b>{P1}<br>Next&nbsp;line<p>{P2}</p><p>Of.</p><aside>See also, this, that, and the other thing over there.</aside>
    <form>Name, mail, and more, please fill in all of it <input></form><p>Last&#46;</article>
    <section id=comments><p>Great post, I like it, thanks, and so on and so forth, for ever.</p></section><footer>&copy; us, now, and later, with all rights</footer></body></html>"""
    assert main_text(page) == f"Title & more {P1} Next line {P2} Of. Last."


def test_divs_only_and_siblings():
    page = f"<body><div class=menu><a href=a>one</a> <a href=b>two</a></div><div><div>{P1}</div><div>{P2}<p>{P1}</p><p>{P2}</p></div><h2>Head</h2><ul><li><a href=1>related one</a><li><a href=2>related two</a></ul></div></body>"
    assert main_text(page) == f"{P1} {P2} {P1} {P2} Head"


def test_text_between_and_beside_kept_parts_stays():
    raw = "This introduction stands bare, beside the container, and belongs to the article."
    assert main_text(f"<body><div id=x>{raw}<div><p>{P1}</p><p>{P2}</p><p>{P1}</p></div></div></body>") == f"{raw} {P1} {P2} {P1}"
    # short blocks, inline elements and bare words between kept siblings
    page = f"<body><div id=x><div><p>{P1}</p><p>{P2}</p></div>bare <b>bold</b> <a href=/z>link</a><p>Short.</p><div>Of.</div><div><p>{P2}</p><p>{P1}</p></div>tail</div></body>"
    assert main_text(page) == f"{P1} {P2} bare bold link Short. Of. {P2} {P1}"
    # sources between paragraphs right in body stay; the menu before them and the links after them do not
    sources = "<ul><li><a href=/s>Source one</a></li><li><a href=/t>Source two</a></li></ul>"
    assert main_text(f"<body><h1>T</h1>{LINKS}<p>{P1}</p>{sources}<p>{P2}</p>{LINKS}</body>") == f"T {P1} Source one Source two {P2}"
    assert main_text(f"<body><div>{LINKS}</div><p>{P1}</p><p>{P2}</p><div>{LINKS}</div></body>") == f"{P1} {P2}"


def test_inline_elements_do_not_split_words():
    assert main_text(f"<article><p>{P1} un<b>split</b>table</p><table><tr><td>a<td>b</table></article>") == f"{P1} unsplittable a b"


def test_edge_cases():
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    assert main_text("plain  text & more < 5") == "plain text & more < 5"
    assert main_text("<article><p>Of.</p></article>") == "Of."
    assert main_text("<p>open <!-- never closed") == "open"
    assert main_text("<p title=it's>a</p><p title='x>y'>b</p>") == "a b"
    assert main_text("<script>x</p>") == ""


def test_deep_and_long_pages_are_linear():
    for source in ("<div>" * 20_000 + P1 + "</div>" * 20_000, "<article>" + f"<p>{P1}</p>" * 20_000, '<a href="' * 3000, "<" * 50_000, "</p>" * 20_000, "<p>" * 20_000, "=\"'" * 5000):
        began = time.time()
        main_text(source)
        assert time.time() - began < 20


def test_scoring_decides_without_article_elements():
    # the longest first paragraph is not where the article is
    page = f"<body><div id=top><p>{P2}</p>{LINKS}{LINKS}{LINKS}{LINKS}</div><div id=x><div>{LINKS}</div><div><p>{P1}</p><p>{P2}</p><p>Short.</p><p>{P1}</p></div></div><table><tr><td>{LINKS}</table></body>"
    assert main_text(page) == f"{P1} {P2} Short. {P1}"
    # an article element that holds little does not win over a container with many paragraphs
    teaser = "<article><h2>Next up</h2><p>Read on, soon.</p></article>"
    assert main_text(f"<body><div>{teaser}{teaser}{LINKS}</div><div><div><p>{P1}</p><p>{P2}</p><p>{P1}</p></div></div></body>") == f"{P1} {P2} {P1}"


def test_several_articles_and_sections():
    posts = "".join(f"<article><h2>Post {i}</h2><p>{P1}</p><p>{P2}</p></article>" for i in range(3))
    assert main_text(f"<body><main>{posts}</main></body>") == " ".join(f"Post {i} {P1} {P2}" for i in range(3))
    parts = "".join(f"<section><h2>Part {i}</h2><div><p>{P1}</p></div></section>" for i in range(8))
    assert main_text(f"<body><nav>{LINKS}</nav><article>{parts}</article></body>") == " ".join(f"Part {i} {P1}" for i in range(8))


def test_nothing_inside_the_article_is_dropped():
    page = f"""<body><article><h1>T</h1><p>{P1}</p><p class=warning>Beware.</p><p class='legal-history'>Of 1900.</p><div class="no-sidebar"><p>Kept.</p></div>
    <p>{P2}</p><h2>References</h2>{LINKS}</article></body>"""
    assert main_text(page) == f"T {P1} Beware. Of 1900. Kept. {P2} References One link here Another link here"


def test_named_parts_inside_the_article_go():
    page = f"""<body class="sidebar-page"><div class="banner-layout"><article><h1>T</h1><p>{P1}</p><div class="ad">Buy, now, cheap.</div><p class="advert">Buy it.</p>
    <div class="share-links">{LINKS}</div><p class="related"><a href=/z>See this</a></p><p>{P2}</p><div id="comments"><article class="comment"><p>{P1} {P1}</p></article></div></article></div></body>"""
    assert main_text(page) == f"T {P1} {P2}"


def test_deep_nesting_takes_linear_time():
    n = 100_000
    for source in ("<div>" * n + P1 + "</section>" * n, "<b>" * n + f"<p>{P1}" * 2000, "<article><header>" * n, "<p><a>" * n, "<ul><li>" * n + "</b>" * n):
        began = time.time()
        main_text(source)
        assert time.time() - began < 30


def brute(page):
    """The text of the article element of the synthetic pages, by patterns that fit only them."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|br|h1)>", " ", inner)
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_whole_table_of_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit(1))
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_nulls_and_empty_table(spark):
    frame = spark.createDataFrame([(1, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract(frame).collect()) == [("", 0), ("x", 1)]
    assert extract(frame.limit(0)).count() == 0
