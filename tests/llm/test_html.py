"""Pages with known articles."""

import html

import pytest

from tollmill.llm.html import extract, main_text

PAGE = """<html><head><title>t</title></head><body class="has-comments"><header><h1>Site</h1></header><div id="menu"><a href=x>a</a></div>
<div class="content"><h1>Head line</h1><p>Long paragraph with, commas, and more text than needed to score here, surely.</p><p>Short.</p>
<div class="ad">Buy, buy, this thing now, cheap offers today.</div><form><p>Enter your mail, name, and other things here please.</p></form>
<ul><li>one item in the list of the article<li>two</ul><p>Another &lt;b&gt; &nbsp; para, with é &#233; text<br>line two, goes on.</p></div>
<div id="comments"><p>First, nice, I like this very much, really, thanks a lot.</p></div><aside>side, bar, text, which is long enough to score</aside>
<footer>foot</footer><script>var p = "</p>";</script></body></html>"""
TEXT = """Head line
Long paragraph with, commas, and more text than needed to score here, surely.
Short.
one item in the list of the article
two
Another <b> para, with é é text line two, goes on."""


def test_article_without_furniture():
    assert main_text(PAGE) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text, no tags", "plain text, no tags"), ("<p>only", "only"), ("<a title=don't>x</a> y's", "x y's"),
    ("<script>x</script>", ""), ("<nav>a</nav>", ""), ("a < b and c > d", "a < b and c > d"), ("<!-- c", ""), ("<article><p>x<p>y", "x\ny"),
    ("<body><p><b>bold<br><p>next</body>", "bold\nnext"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_article_header_keeps_the_headline():
    page = "<body><article><header><h1>Title here</h1><p>by someone</p></header><p>" + "Text, and more of it. " * 9 + "</p></article></body>"
    assert main_text(page).startswith("Title here\nText, and")


def test_all_paragraphs_of_a_long_article_stay():
    paragraphs = [f"Paragraph number {i}, with a comma." for i in range(3000)]
    page = "<body><div class='sidebar'>x, y, z</div><div><div>" + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs) + "</div></div></body>"
    assert main_text(page).split("\n") == paragraphs


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (2, None, None, "z"), (None, "v", "", "z")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), ["page_id", "url"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(got.limit(0).withColumnRenamed("text", "html"), ["page_id"]).count() == 0


LONG = "One long paragraph, with commas, that says a thing or two about the matter."


@pytest.mark.parametrize("page, lines", [
    (f"<article class='post has-sidebar'><p>{LONG}<p>{LONG}</article>", [LONG, LONG]),
    (f"<div class='content no-comments'><p>{LONG}<p>{LONG}</div>", [LONG, LONG]),
    (f"<article class='category-social'><p>{LONG}<p>{LONG}</article>", [LONG, LONG]),
    (f"<article><div class='entry-header'><h1>Headline</h1></div><p>{LONG}</p></article>", ["Headline", LONG]),
    (f"<div class='entry-header'><h1>Headline</h1></div><div><p>{LONG}</p><p>{LONG}</p></div>", ["Headline", LONG, LONG]),
    (f"<div><section><p>{LONG}<p>{LONG}</section><section><p>{LONG}</section><section>last words</section></div>", [LONG, LONG, LONG, "last words"]),
    (f"<article><p>{LONG}<p>{LONG}</article><article><p>{LONG}</article>", [LONG, LONG, LONG]),
    (f"<div class='wide sidebar'><div class='ads'>{LONG}</div><p>{LONG}<p>{LONG}<p>{LONG}</div>", [LONG, LONG, LONG]),
    (f"<div><p>{LONG}<p>{LONG}</div><div class='sidebar'><p>{LONG}</div><div id='comments'>" + f"<p>{LONG}" * 9 + "</div>", [LONG, LONG]),
])
def test_words_of_classes_and_siblings(page, lines):
    assert main_text(page).split("\n") == lines


@pytest.mark.parametrize("page", [
    "<div>some text, of it " * 20_000, "</li>" * 20_000 + "x", "<ul>" + "<li>a" * 20_000, "<b>x" * 20_000 + "<p>q</p>" * 1000,
    "<div>" * 20_000 + "</b>" * 20_000, "<ul><li>" + "<div>" * 8000 + "<li>x" * 8000,
])
def test_deep_pages_take_time_by_their_length(page):
    import time

    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3


def _plain(page):
    """The same rules, worked out anew from the blocks for every element."""
    from tollmill.llm import html as H

    blocks, elements = H._read(page or "")
    chain = lambda e: [e] + (chain(e.parent) if e.parent else [])
    held = lambda e, bs: sum(len(b.text) for b in bs if e in chain(b.element))
    total = held(elements[0], blocks)
    gone = [e for e in elements if e.out or e.doubt == "firm" or (e.doubt or e.tag == "form") and 2 * held(e, blocks) < total]
    blocks = [b for b in blocks if not set(chain(b.element)) & set(gone) and (b.element.tag in H.HEADINGS or not b.element.header)]
    if not blocks:
        return ""
    density = lambda e: sum(b.linked for b in blocks if e in chain(b.element)) / max(1, held(e, blocks))

    def score(e):
        points = 0
        for b in blocks:
            if b.element.tag in H.HEADINGS or len(b.text) < H.SHORTEST:
                continue
            holders = chain(b.element)[b.element.tag in ("p", "pre", "li", "td", "dd", "blockquote") :]
            if e in holders:
                points += (1 + b.text.count(",") + b.text.count("，") + min(len(b.text) / 100, 3)) / 2 ** holders.index(e)
        return points * (1 - density(e))

    best = max(elements, key=lambda e: (round(score(e), 9), -e.index))
    if score(best) <= 0:
        best = next((e for e in elements if e.tag in H.ARTICLES and held(e, blocks) and not set(chain(e)) & set(gone)), elements[0])
    chosen = next((e for t in ("article", "main") for e in chain(best) if e.tag == t), best)
    kept = {chosen}
    for e in elements:
        if chosen.parent is None or chosen.tag == "main" or e.parent is not chosen.parent or e in gone or not held(e, blocks):
            continue
        plain = e.tag in ("p", chosen.tag) and (density(e) < 0.25 if held(e, blocks) > 80 else density(e) == 0)
        headline = (e.tag in H.HEADINGS or e.header) and e.index < chosen.index and density(e) < 0.25
        if 0 < score(e) >= 0.2 * score(chosen) or plain or headline:
            kept.add(e)
    return "\n".join(b.text for b in blocks if set(chain(b.element)) & kept)


def test_against_a_plain_version(spark):
    from tests.conftest import DATA

    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert [main_text(p) for p in pages] == [_plain(p) for p in pages]


def test_query_columns(spark):
    from tests.conftest import DATA
    from tollmill.llm.queries import QUERIES

    got = QUERIES["op4_html"](spark, DATA)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.filter("n_chars <> length(text)").count() == 0
    assert got.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
