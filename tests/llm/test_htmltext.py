"""Main text of small pages, by hand, and of the given pages against a plain reading of their template."""

import html as H
import re
import time

import pytest

from lexitally.llm import htmltext as X

LONG = "A sentence, with commas, that is long enough to count as a paragraph of main text"
PAGES = [
    ("article", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav>"
     f"<article><h1>Head</h1><p>{LONG} 1.</p><p>Tiny.</p><ul><li>one<li>two</ul></article>"
     f"<aside>side</aside><footer>foot</footer></body></html>", f"Head\n{LONG} 1.\nTiny.\none\ntwo"),
    ("unclosed", f"<article><p><b>First.<br><p>{LONG}&amp; &lt;x&gt; caf&eacute;&#33;<p>Last", f"First.\n{LONG}& <x> café!\nLast"),
    ("space", f"<article><p>  a \n\t b&nbsp;&nbsp;c <i>d</i>e</p><p> </p><p>{LONG}</p></article>", f"a b c de\n{LONG}"),
    ("script", f"<article><script>var t='</p><p>no'</script><p>{LONG}</p><!-- <p>no</p> --><form><p>{LONG}</p></form></article>", LONG),
    ("divs", f"<div class='menu'><p>{LONG}</p></div><div id=content><p>{LONG} a</p><p>short</p><p>{LONG} b</p></div>"
     f"<div class='sidebar left'><p>{LONG}</p></div><div id='comments'><p>{LONG}, x, y, z</p></div>", f"{LONG} a\nshort\n{LONG} b"),
    ("links", f"<div><p><a href=1>{LONG}</a></p><p><a>{LONG}</a></p></div><div><p>{LONG} body</p></div>", f"{LONG} body"),
    ("comments in article", f"<article><header><h1>T</h1></header><p>{LONG}</p><div class=\"comments\"><article class=comment><p>{LONG}!"
     f"</p></article></div><div class='cookie-notice'>ok</div></article>", f"T\n{LONG}"),
    ("siblings", f"<div><p>{LONG} 1</p><p>{LONG} 2</p></div>", f"{LONG} 1\n{LONG} 2"),
    ("no paragraph", "<body><main><h1>Only a head</h1></main><p>x</p></body>", "Only a head"),
    ("text only", "just text", "just text"), ("empty", "", ""), ("null", None, ""), ("no text", "<p></p><br>", ""),
    ("odd", "a < b <3 </ <p><!doctype", "a < b <3 </\n<!doctype"), ("attr", f"<article><p title='a > b' class=x>{LONG}</p></article>", LONG),
    ("table", f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG}\na\nb\nc"),
    ("hidden", f"<article><p>{LONG}</p><div hidden>h</div><div style='display: none'>s</div></article>", LONG),
]


@pytest.mark.parametrize("name, page, text", PAGES, ids=[p[0] for p in PAGES])
def test_small_pages(name, page, text):
    assert X.main_text(page) == text


def plain(page):
    """The article of the given pages' template: head line, then what stands between paragraph tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    got = X.extract(df).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_long_deep_and_broken_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert X.main_text(deep) == LONG
    assert len(X.main_text(f"<article><p>{LONG * 5000}</p></article>")) == len(LONG) * 5000
    X.main_text("<a '" * 3000)
    X.main_text("<" * 5000 + "&" * 5000)


@pytest.mark.parametrize("page, n", [
    ("<div>A sentence of its own on each level. " * 100_000, 100_000),
    ("<div><span>" + "<div><p>A sentence of its own on each level.</p>" * 20_000, 20_000),
    ("<div><div><p>A sentence of its own on each level.</p>" * 20_000, 20_000)])
def test_deep_pages_keep_all_text_in_linear_time(page, n):
    start = time.monotonic()
    assert X.main_text(page).count("A sentence of its own on each level.") == n
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("page", [
    "<b>" * 50_000 + "x <p>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<article>" * 50_000 + "<header>" * 50_000,
    "<a '" * 100_000, "<div class=sidebar><p>Some words, with a comma.</p>" * 30_000, "<ul><li><a href=x>" * 30_000,
    "<article><p>Some words.</article></p></b>" * 30_000])
def test_odd_deep_pages_take_linear_time(page):
    start = time.monotonic()
    X.main_text(page)
    assert time.monotonic() - start < 20


def test_a_line_above_the_container_does_not_widen_it():
    body = "".join(f"<p>{LONG}, {i}</p>" for i in range(12))
    page = f"<div><div class=x><a href=1>Home</a> <a href=2>News</a></div><div><div>{body}</div></div>A line about rights, of the page.</div>"
    assert X.main_text(page) == "\n".join(f"{LONG}, {i}" for i in range(12))


def test_frame(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", f"<p>{LONG}</p>", 2)],
                               "page_id long, url string, html string, n_chars long")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in X.extract(df).collect())
    assert got == [(0, LONG, len(LONG)), (1, "", 0), (1, "", 0)]
    assert X.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("attrs", [
    'data-hidden="false"', 'title="a hidden truth"', "title='id=comments class=ad'", 'data-id="social"', 'data-class="ad"',
    'data-role="search"', 'data-x="aria-hidden=true"', 'alt="style=display:none"', "data-q=/find?id=search", 'title = "x hidden"',
    'x-hidden', 'class="text"class="ad"', 'title="a"data-hidden'])
def test_only_attributes_of_the_exact_name_count(attrs):
    assert X.main_text(f"<article><p>{LONG} 1</p><div {attrs}>{LONG} 2</div></article>") == f"{LONG} 1\n{LONG} 2"


@pytest.mark.parametrize("href", ["/trail/hidden-lake", "/find?id=search", "/a?class=ad&role=navigation", "x hidden"])
def test_words_inside_link_targets_are_not_attributes(href):
    assert X.main_text(f'<article><p>{LONG} <a href="{href}">to the lake</a></p></article>') == f"{LONG} to the lake"


@pytest.mark.parametrize("attrs", [
    "hidden", "HIDDEN", 'hidden=""', "hidden=hidden/", 'title="a" hidden', 'title="a"hidden', "class=ad", "CLASS = 'ad'", 'id="comments"',
    "role=navigation", "aria-hidden='true'", 'style="color:red; display: none"', "title='>' id=comments"])
def test_hiding_attributes_still_count(attrs):
    assert X.main_text(f"<article><p>{LONG} 1</p><div {attrs}>{LONG} 2</div></article>") == f"{LONG} 1"


def test_long_attributes_take_linear_time():
    X.main_text("<p " + "a = " * 200000 + ">" + "<p " + " " * 500000 + "x>" + "<p " + "=" * 500000 + ">")


@pytest.mark.parametrize("name", ["category-reviews", "tag-social has-comments", "story-header", "with-sidebar", "no-sidebar",
                                  "search-result", "content-sidebar-wrap", "content sidebar", "reviews"])
def test_furniture_words_inside_other_names_leave_the_main_text(name):
    page = (f"<body><div class=menu><a href=1>{LONG}</a></div><article class='post {name}'><p>{LONG} 1</p><p>{LONG} 2</p></article>"
            f"<p>Copyright of the page.</p></body>")
    assert X.main_text(page) == f"{LONG} 1\n{LONG} 2"
    if name != "reviews":
        page = f"<div><div class='{name}'><p>{LONG} 1</p><p>{LONG} 2</p></div><div class=footer>{LONG}</div></div>"
        assert X.main_text(page) == f"{LONG} 1\n{LONG} 2"
        inner = f"<article><p>{LONG} 1</p><div class='{name}'><p>{LONG} 2</p></div></article>"
        assert X.main_text(inner) == f"{LONG} 1\n{LONG} 2"


@pytest.mark.parametrize("name", ["sidebar", "right-sidebar", "widget", "search"])
def test_places_that_hold_most_of_the_paragraphs_stay(name):
    page = f"<div class='{name}'><p>{LONG} 1</p><p>{LONG} 2</p><p>{LONG} 3</p></div><p>A short line of another kind.</p>"
    assert f"{LONG} 1\n{LONG} 2\n{LONG} 3" in X.main_text(page)


@pytest.mark.parametrize("name", ["comments", "reviews", "promo", "search"])
def test_nothing_else_left(name):
    assert X.main_text(f"<div class='{name}'><p>{LONG} 1</p><p>{LONG} 2</p></div>") == f"{LONG} 1\n{LONG} 2"
    assert X.main_text(f"<div class='{name}' hidden><p>{LONG} 1</p></div>") == ""


@pytest.mark.parametrize("name", ["ad-slot", "ad_300x250", "cookie-notice", "related-posts", "post-comments", "comment-list",
                                  "site-footer", "left-sidebar", "c-share", "newsletter-signup", "x comments y"])
def test_names_of_furniture_are_left_out(name):
    page = f"<article><p>{LONG} 1</p><p>{LONG} 2</p><div class='{name}'><p>{LONG} 3</p></div></article>"
    assert X.main_text(page) == f"{LONG} 1\n{LONG} 2"


def test_long_comments_do_not_outweigh_a_short_text():
    page = f"<div id=content><p>{LONG}</p></div><div class=comments>" + f"<article class=comment><p>{LONG}!</p></article>" * 40
    assert X.main_text(page + "</div>") == LONG
