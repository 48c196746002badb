"""Main text of pages, and the inferred wrappers."""

import re
from html import unescape

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.wrappers import extract_main_text, infer_wrappers, main_text, merged, page_expression, rules_of, written

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><nav>Menu<ul><li>x<li>y</ul></nav>
<div class="cookie-notice">We use</div><div id=topBanner>b</div><main><h1>T &amp; U</h1><p>Hello <b>big</b>
 world<p>two<br>lines<div class="ad">buy</div><script>if(a<b)"</p>"</script><ul><li>one<li>two</ul><!-- <p>no</p> -->
<form><p>name</p></form><table><tr><td>a<td>b&nbsp;&#233;</table><p hidden>h</p><section id="comments"><p>nice!</p></section></main>
<aside>s</aside><footer>f</footer></body></html>"""


def test_page_by_its_markup():
    assert main_text(PAGE, None) == "T & U\nHello big world\ntwo lines\none\ntwo\na\nb é"


def test_broken_pages():
    assert main_text("", None) == ""
    assert main_text("plain  text", None) == "plain text"
    assert main_text("<p>a<p>b</i></div>c", None) == "a\nbc"
    assert main_text("<p>a <script>never closed <p>b", None) == "a"
    assert main_text("<p title=\"x > y\" class='a'>q</p><p title=it's>r</p>", None) == "q\nr"
    assert main_text("<p>1 < 2 &lt; 3 <!-- open", None) == "1 < 2 < 3"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 2000, None) == "deep"


def plain(html):
    """For the tables' pages: what lies in the article, block by block."""
    inner = html[html.index("<article>") :]
    inner = re.sub(r"<footer.*", "", inner.split("</article>")[0], flags=re.S)
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)\b[^>]*>", inner))
    return "\n".join(b for b in blocks if b)


def test_query_extracts_every_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{BASE}/pages.parquet").collect()}
    got = {r.page_id: r for r in CASES["op9_main_text"].run(spark, BASE).collect()}
    assert set(got) == set(pages)
    assert all(r.text == plain(pages[i]) and r.n_chars == len(r.text) for i, r in got.items())


def test_wrapper_covers_optional_repeated_and_variable_parts():
    a = page_expression("<body><h1>A</h1><p>x</p><p>y</p><footer>same</footer></body>")
    b = page_expression("<body><h1>B</h1><p>z</p><table><tr><td>1</table><footer>same</footer></body>")
    assert written(merged(a, b)) == '(body(h1(#) p(#)+ table(tr(td("1")))? footer("same")))'
    c = page_expression("<dl><dt>1<dd>2<dt>3<dd>4</dl>")
    assert written(c) == "(dl(dt(#)+ dd(#)+))"
    assert written(merged(a, a)) == written(a)


def test_main_part_without_an_article_element(spark):
    page = lambda i: f"<body><div class=top><a>Home</a></div><div class='post-12{i}'><p>Long text number {i} with many more words</p></div><div class=x>Always the same line</div></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Long text number {i} with many more words" for i in range(12)}


def test_template_lines_go_and_copies_stay():
    page = lambda i: f"<article><h1>Same head</h1><p>body {i}</p><div>Subscribe now</div></article>"
    several = page_expression(page(0))
    for i in range(1, 12):
        several = merged(several, page_expression(page(i)))
    assert main_text(page(3), rules_of(several)) == "Same head\nbody 3"
    copies = page_expression(page(0))
    for _ in range(12):
        copies = merged(copies, page_expression(page(0)))
    assert main_text(page(0), rules_of(copies)) == "Same head\nbody 0\nSubscribe now"


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, rules string, h string"
    rows = [(1, None, "<p>a</p>"), (2, "not a url", "<p>b</p>"), (3, "http://H/x", None), (4, "http://h/y", ""), (5, "http://h/z", "<p>" + "w " * 100_000), (5, "http://h/z", "<p>twice")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    got = sorted((r.page_id, r.n_chars) for r in extract_main_text(df).collect())
    assert got == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 5), (5, 199_999)]
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []
    assert {r.host for r in infer_wrappers(df).collect()} == {"", "h"}
