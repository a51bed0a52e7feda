"""Main text of pages by line blocks."""

import html
import re

import pytest

from scriptorium.llm.main_text import extract, kept, lines, main_text, main_text_report

LONG = "This is a sentence of the article that goes on for some time, as sentences of articles do."
CHROME = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News of today</a></li></ul></nav>'


def page(body, more=""):
    return f'<!DOCTYPE html><html><head><title>T {LONG}</title><style>p{{margin:0}}</style><script>var t="</p>";{LONG}</script>{more}</head><body>{body}</body></html>'


def test_pages_of_the_table(spark):
    """Every article of the given pages, as its own regular expressions see it, in whole."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in main_text_report(pages).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", pages.where(f"page_id = {r.page_id}").first().html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_surge_and_dive_without_named_elements():
    """No element tells the article: short linked lines before and after it go, short paragraphs inside it stay."""
    menu = "".join(f'<div><a href="/{k}">Menu entry {k}</a></div>' for k in range(9))
    short = "<div>No.</div><div>Yes, of course.</div>"
    text = page(menu + "<div>Login</div>" + f"<h2>The title</h2><div>{LONG}</div>{short}<div>{LONG} {LONG}</div>" + menu + "<div>Imprint</div><div>About us</div><div>2024</div>")
    assert main_text(text).split("\n") == ["The title", LONG, "No.", "Yes, of course.", f"{LONG} {LONG}"]


@pytest.mark.parametrize(
    "part",
    ['<div class="ad">%s</div>', '<aside>%s</aside>', '<div id="cookie-notice"><p>%s</p></div>', "<form><p>%s</p></form>", '<section class="comments"><article><p>%s</p></article></section>',
     '<div class="sidebar widget">%s</div>', "<footer><p>%s</p></footer>", "<header>%s</header>", '<div role="navigation">%s</div>', '<div style="display: none">%s</div>', "<!-- %s -->", "<noscript>%s</noscript>",
     '<div class="post-comments"><div><p>%s</p></div></div>', "<p hidden>%s</p>", '<ul class="breadcrumb"><li>%s</li></ul>', '<div class="newsletterSignup">%s</div>'],
)
@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="page-wrapper has-sidebar">%s</div>'])
def test_boilerplate_goes(part, frame):
    other = "Other words that are long enough to look like a paragraph of the article, and a few words more than that."
    article = f"<h1>A title</h1><p>{LONG}</p><p>Be.</p><p>{LONG}</p>"
    want = ["A title", LONG, "Be.", LONG]
    assert main_text(page(CHROME + part % other + frame % article + part % other)).split("\n") == want
    inner = article.replace("<p>Be.</p>", "<p>Be.</p>" + part % other)
    if not part.startswith("<header"):  # an article's own header holds its title
        assert main_text(page(CHROME + frame % inner)).split("\n") == want


def test_broken_markup():
    text = f"<body><article><h1>Title</h1><p><b>First &amp; {LONG}<br><p>Second<p>Third &lt;3&nbsp;&#233; a < b</b></p><ul><li>x <i>y</i>z<li>w</ul><p>{LONG}</p>"
    assert main_text(text).split("\n") == ["Title", "First & " + LONG, "Second", "Third <3 é a < b", "x yz", "w", LONG]
    assert main_text("<p title='>'>" + LONG) == LONG and main_text("<!-- " + LONG) == "" and main_text("<script>" + LONG) == ""
    assert main_text("<") == main_text("<a") == main_text("") == "" and main_text(LONG + "<a <b") .startswith(LONG)


def test_equal_lines_and_two_runs():
    twice = page(f"<div>{LONG}</div>" * 3 + "<div>-</div>" * 6 + f"<div>{LONG}</div>" * 3)
    assert main_text(twice).split("\n").count(LONG) == 6
    assert kept([]) == [] and lines("") == []


def test_odd_pages(spark):
    big = page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", page(f"<p>{LONG}</p>")), (3, "u", page(f"<p>{LONG}</p>")), (4, "u", big), (5, "u", "<div>" * 100_000 + LONG), (6, "u", "<b " * 100_000), (7, "u", "no markup at all. " * 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as `a.b`")
    got = [(r.page_id, r.text, r.n_chars) for r in main_text_report(df).collect()]
    by = {k: t for k, t, _ in got}
    assert len(got) == 9 and all(n == len(t) for _, t, n in got)
    assert by[1] == by[2] == by[None] == "" and by[3] == by[5] == LONG and by[4].count("\n") == 19_999 and by[7] == ("no markup at all. " * 9).strip()
    assert extract(df).columns == ["page_id", "url", "n_chars", "a.b", "text"] and main_text_report(df.limit(0)).collect() == []
