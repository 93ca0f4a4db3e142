"""Main text of pages: templates counted per host, named parts, broken markup."""

import random

import pytest
from pyspark.sql import functions as F

from folio.llm.site_templates import Page, host, main_text

WORDS = "house river people window garden letter summer morning teacher doctor island market winter bridge".split()


def _prose(seed, n=30):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def _text(html, template=frozenset()):
    return Page(html, template).text()


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain  text\n only", "plain text only"), ("<p>a</p><p>b</p>c", "a b c"), ("a<b>b</b>c <i> d</i>", "abc d"),
    ("<p>1 &lt; 2 &amp;amp; &eacute;&#233;&#xe9; &nbsp;x&nbsp;", "1 < 2 &amp; ééé x"), ("a<br>b<br/>c", "a b c"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b 1 2 3"), ("<p>a<p>b<div>c</div>", "a b c"),
    ("<script>var t='</p><p>no';</script>x<style>p{}</style>y<!-- <p>no</p> -->z", "xyz"), ("<SCRIPT>no</ScRiPt >yes", "yes"),
    ("<script>never closed <p>x", ""), ("a <!-- never closed <p>b", "a"), ("<p title='a > b'>x</p>", "x"), ('<p title="never closed>x</p>', "x"),
    ("a < b and <3", "a < b and <3"), ("<title>t</title><body>x", "x"), ("<p><b>bold<br></article>tail", "bold tail"), ("</p></div>x", "x"),
    ("<div hidden>no</div><p style='display: none'>no</p><span aria-hidden=true>no</span>x", "x"), ("<noscript>no</noscript>x", "x"),
    ("<textarea>no</textarea><select><option>no<option>no</select><button>no</button>x", "x"), ("<svg><text>no</text></svg>x", "x"),
])
def test_blocks_entities_and_broken_markup(html, text):
    assert _text(html) == text


def test_parts_that_say_what_they_are():
    page = """<body class="home no-sidebar"><header><a>logo</a></header><nav>menu</nav><div id="cookie-notice">consent</div>
    <div class="Ad-Slot ad">buy</div><main class="content has-sidebar"><article><h1>Title</h1><p>First.</p><aside>see also</aside>
    <div class="share-buttons">share</div><form>mail</form><p>Second.</p></article>
    <section id="comments"><article class="comment"><p>first!</p></article></section></main>
    <div role="complementary">links</div><footer>2026</footer></body>"""
    assert _text(page) == "Title First. Second."
    assert _text(page.replace("main", "div")) == "Title First. Second."
    assert _text("<div class='sidebar-layout'><h1>Title</h1><p>kept</p></div>") == "Title kept"
    assert _text("<article class='post related-posts-on'><h1>T</h1>x</article><article class='teaser related'>no</article>") == "T x"
    assert _text("<article>one</article><article>two <article>inner</article></article>") == "one two inner"


def test_deep_and_long_pages():
    assert _text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert _text(f"<p>{long}</p>") == long
    assert _text('<a "' * 3_001 + "x") in ("", "x")  # open quotes: ends in time


def _site(name, n, article, extra=""):
    """Pages without any telling name: only counting can find the menu, the box and the imprint."""
    for k in range(n):
        menu = "".join(f"<div><a href='/{w}'>{w}</a></div>" for w in WORDS[:5])
        yield (f"{name}-{k}", f"https://{name}.example/{k}",
               f"<html><body><div class=x1><div>{menu}</div></div><div><span>Call us today</span></div>{extra}{article(k)}<div>Imprint {name}</div></body></html>")


def _run(spark, pages, **more):
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    return {r.page_id: r.text for r in main_text(df, **more).select("page_id", "text").collect()}


def test_templates_are_found_by_counting(spark):
    pages = list(_site("big", 40, lambda k: f"<div><h2>Head {k}</h2><div>{_prose(k)}</div></div>"))
    pages += list(_site("tiny", 3, lambda k: f"<div>{_prose(100 + k)}</div>"))
    got = _run(spark, pages)
    assert all(got[f"big-{k}"] == f"Head {k} {_prose(k)}" for k in range(40))
    # Three pages are no many pages of a host: nothing is known to be a template there.
    assert all(got[f"tiny-{k}"].endswith("Imprint tiny") for k in range(3))
    # Without the count the same pages keep their menus.
    assert _run(spark, pages, min_pages=1000)["big-0"].startswith("house river people window garden Call us today Head 0")


def test_the_same_box_on_another_host_is_no_template(spark):
    pages = list(_site("one", 20, lambda k: f"<div>{_prose(k)}</div>"))
    pages.append(("guest", "https://guest.example/", "<body><div><span>Call us today</span></div><div>text</div></body>"))
    assert _run(spark, pages)["guest"] == "Call us today text"


def test_copies_of_an_article_stay(spark):
    pages = list(_site("copies", 60, lambda k: f"<div>{_prose(7 if k < 50 else k)}</div>"))
    got = _run(spark, pages)
    assert all(got[f"copies-{k}"] == _prose(7) for k in range(50))


def test_prose_that_many_articles_quote_stays(spark):
    pages = list(_site("quotes", 60, lambda k: f"<article><h1>H {k}</h1><p>{_prose(k)}</p><p>As everybody says.</p><div><a>Print</a> <a>Mail</a></div></article>"))
    got = _run(spark, pages)
    assert all(got[f"quotes-{k}"] == f"H {k} {_prose(k)} As everybody says." for k in range(60))


def test_odd_rows(spark):
    pages = [("1", None, "<p>a</p>"), ("2", "no url", "<p>b</p>"), ("3", "https://h.example", None), (None, "https://h.example/x", "<p>c"),
             ("4", "https://h.example/y", "<p>d"), ("4", "https://h.example/y", "<p>d")]
    df = spark.createDataFrame([(*p, 1, "t") for p in pages], "page_id string, url string, html string, uid int, template string")
    out = main_text(df)
    assert out.columns == [*df.columns, "text"]
    assert sorted((r.page_id or "", r.text, r.uid, r.template) for r in out.collect()) == [
        ("", "c", 1, "t"), ("1", "a", 1, "t"), ("2", "b", 1, "t"), ("3", "", 1, "t"), ("4", "d", 1, "t"), ("4", "d", 1, "t")]
    assert main_text(df.where("page_id = 'none'")).count() == 0
    with pytest.raises(ValueError, match="template"):
        main_text(df, out="template")


def test_hosts(spark):
    urls = ["https://A.Example:8080/x", "http://u:p@b.example?q", "ftp://c.example#f", "mailto:x@y", "", None, "https:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host(F.col("u"))).collect()] == ["a.example", "b.example", "c.example", None, None, None, None]


def test_the_query_equals_the_articles(spark, sf_small):
    """The test pages hold their text in one article each: a plain cut of the markup is the truth."""
    import html
    import re

    from folio.llm.queries import QUERIES

    pages = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    plain = lambda h: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search("<article>(.*?)</article>", h, re.S).group(1))).split())
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op13_html_extraction"](spark, sf_small).collect()}
    assert got == {p.page_id: (plain(p.html), len(plain(p.html))) for p in pages}
