import html.parser
import re

import pytest
from pyspark.sql import functions as F

from staffline.llm import html_text as h
from staffline.llm.queries import op9_html_text


class Article(html.parser.HTMLParser):
    """The article's blocks, by another parser."""

    BLOCK = {"p", "h1", "h2", "li", "div", "article", "section", "ul"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.open = False, [], ""

    def flush(self):
        text = re.sub(r"\s+", " ", self.open).strip()
        if text:
            self.blocks.append(text)
        self.open = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.open += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.open += data


def article(source):
    parser = Article()
    parser.feed(source)
    parser.close()
    parser.flush()
    return "\n".join(parser.blocks)


def test_query_against_another_parser(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op9_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page-{n}">
<header><a href="/">Site</a> news</header><nav><ul>{nav}</ul></nav>
<div class="cookie-notice">We use cookies</div>
<div id="content-{n}"><h1>Title {n} &amp; more</h1><p>First&nbsp;paragraph of {n}
with   spaces<p>Second <b>bold</b><br>line &#8212; {n}<script>var x = "<p>no</p>";</script>
<ul><li>point one {n}<li>point two {n}</ul><p>{long}</p></div>
<div class="sidebar">Also read <a href="#">this</a></div>
<form><input name=q><label>Search</label></form>
<div class="comments"><p>First reader of {n} writes a comment that is rather long, to be sure that length does not decide.</p></div>
<!-- <p>gone</p> --><footer>&copy; site</footer></body></html>"""


def page(n):
    return PAGE.format(n=n, nav="".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(n % 4 + 1)), long=f"A longer text {n}. " * 20)


def expected(n):
    return "\n".join([f"Title {n} & more", f"First paragraph of {n} with spaces", f"Second bold line — {n}", f"point one {n}", f"point two {n}", ("A longer text %d. " % n * 20).strip()])


@pytest.mark.parametrize("part", [256, 2])
def test_pages_without_an_article_element(spark, monkeypatch, part):
    monkeypatch.setattr(h, "PART", part)
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(9)]
    rows += [(20, "http://a.example/odd", "<p>only a paragraph, of no wrapper"), (21, "http://a.example/cut", page(3)[:1400] + '<a href="')]
    rows += [(30, None, page(1)), (31, "http://a.example/null", None), (32, "http://b.example/", ""), (32, "http://b.example/", ""), (33, "no url", "just text &lt;b&gt;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("x"), "region": F.lit("y")})
    out = h.main_texts(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for i in range(9):
        assert texts[i] == expected(i)
    assert texts[20] == "only a paragraph, of no wrapper" and texts[30] == expected(1)
    assert texts[31] == texts[32] == "" and texts[33] == "just text <b>"
    assert h.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("around, inside", [
    ('<div class="layout sidebar-right"><article>{}</article></div>', "<p>{}</p>"), ('<div class="content-with-sidebar right-sidebar">{}</div>', "<p>{}</p>"),
    ('<article class="x">{}</article>', '<div class="social-sciences"><p>{}</p></div>'), ("<article>{}</article>", '<p class="news-alert">{}</p>'),
    ("<article>{}</article>", '<p>The <span class="search-result">{}</span> end</p>'), ("<main>{}</main>", "<p>x <math><mi>{}</mi></math> <xmp><b>y</xmp></p>"),
    ("<main>{}</main>", "<noscript><p>{}</p></noscript><object>fallback</object>"),
])
def test_names_and_fallbacks_do_not_empty_the_article(spark, around, inside):
    text = lambda n: " ".join(f"word{n}x{i}" for i in range(30))
    extra = '<div class="sidebar">Also <a href="#">this</a></div><div class="comments"><article>I agree with {}</article></div>'
    rows = [(n, "http://a.example/", "<body>" + around.format(f"<h1>Title {n}</h1>" + inside.format(text(n))) + extra.format(n) + "</body>") for n in range(4)]
    got = {r.page_id: r.text for r in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    shown = {"search-result": "The {} end", "math": "x {} <b>y", "noscript": "{}\nfallback"}
    form = next((v for k, v in shown.items() if k in inside), "{}")
    for n, _, source in rows:
        assert got[n] == f"Title {n}\n" + form.format(text(n)) == h.main_text(h.parse(source), None)


def tree(source):
    return h.fold(h.parse(source).tree)


def test_wrappers_become_optional_repeated_and_slots():
    a = tree("<div><h1>x</h1><p>one</p><p>two</p></div>")
    b = tree("<div><h1>y</h1><table><tr><td>c</table><p>three</p></div>")
    assert h.written(h.align(a, b)) == "<div><h1>#text</> <table><tr><td>#text</></></>? <p>#text</>+</>"
    many = tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert h.written(many) == "<dl>(<dt>#text</> <dd>#text</>)+</>"
    assert h.align(a, a) == a
    assert set(h.paths(many)) == {("dl", "dt"), ("dl", "dd")}


def test_broken_markup_is_read_in_linear_time():
    import time

    began = time.time()
    for source in ("<" * 50_000, "<a " + 'x="' * 30_000, "<p>" * 20_000, "<!--" * 30_000, "</p>" * 30_000 + "&#" * 30_000):
        h.main_text(h.parse(source), None)
    assert time.time() - began < 20


def test_deeply_nested_pages(spark):
    """Thousands of elements in one another, of one host and alone; nothing is lost."""
    for n in (90, 101, 700, 5000):
        body = "<div>" * n + "<p>the inner text</p>" + "</div>" * n + "<p>the outer text</p>"
        page = f"<html><body><article><h1>Title {n}</h1>{body}</article></body></html>"
        pages = spark.createDataFrame([(i, f"http://deep{n % 7}.org/{i}", page.replace("Title", f"Title {i}")) for i in range(3)], "page_id bigint, url string, html string")
        for r in h.main_texts(pages).collect():
            assert r.text == f"Title {r.page_id} {n}\nthe inner text\nthe outer text"


def test_attributes_are_read_by_name(spark):
    """Words in values of other attributes name nothing."""
    kept = ['<p title="a hidden gem">one {}</p>', '<p data-role="comment-target">two {}</p>', '<p data-id=reply>three {}</p>',
            '<h2 class="share-price">four {}</h2>', "<p data-class='sidebar' hidden-note=x>five {}</p>"]
    html = "<body><main><article>" + "".join(kept) + '<div class="comments"><p>a reader {}</p></div></article></main></body>'
    rows = [(i, f"http://names.org/{i}", html.replace("{}", f"of page {i} with text of its own {i * 7919}")) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in h.main_texts(pages).collect():
        assert [line.split()[0] for line in r.text.split("\n")] == ["one", "two", "three", "four", "five"]
