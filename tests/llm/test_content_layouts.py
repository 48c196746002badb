"""Layouts of pages: titles around inner elements, forms, headers, deep pages, long attributes, hosts that name no main part."""

import pytest

from tidemark.llm.wrappers import extract_main_text, main_text, packed_expression, page_expression, rules_of, unpacked_expression, merged

BODY = " ".join(["long body text number {n}"] * 80)
LAYOUTS = {
    "main": "<main><h1>Title {n}</h1><p>Lead {n}</p><article><p>" + BODY + "</p></article></main>",
    "post": '<div class="post"><h1>Title {n}</h1><p>Lead {n}</p><div class="entry-content"><p>' + BODY + "</p></div></div>",
    "around": "<main><nav>Menu</nav><h1>Title {n}</h1><p>Lead {n}</p><article><p>" + BODY + "</p></article><aside>More {n}</aside></main>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_title_and_lead_stay(spark, layout):
    page = "<html><body><header>Site</header>" + LAYOUTS[layout] + "<footer>Foot</footer></body></html>"
    rows = [(n, f"http://a.b/{n}", page.replace("{n}", str(n))) for n in range(12)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Title {n}\nLead {n}\n" + BODY.replace("{n}", str(n)) for n in range(12)}


def extracted(spark, pages, host="http://a.b"):
    rows = [(n, f"{host}/{n}", page) for n, page in enumerate(pages)]
    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_other_stories_after_an_inner_element_go(spark):
    page = "<main><h1>Title {n}</h1><article><p>" + BODY + "</p></article><p>Correction {n}</p><ul><li>Other story {n}</ul><div><h3>More {n}</h3><p>teaser</p></div></main>"
    got = extracted(spark, [page.replace("{n}", str(n)) for n in range(4)])
    assert got == {n: f"Title {n}\n" + BODY.replace("{n}", str(n)) + f"\nCorrection {n}" for n in range(4)}


def test_forms_headers_and_single_words_of_class_lists():
    body = "words of the article that are many " * 5
    assert main_text(f"<body><form action=x><div><p>{body}</p></div></form><form><label>Name</label><p>Ask us</p></form></body>", None) == body.strip()
    assert main_text(f"<header>Site</header><article><header><h1>Title</h1><p>By A</p></header><p>{body}</p></article>", None) == "Title\nBy A\n" + body.strip()
    assert main_text(f"<header>Site</header><main><p>{body}</p></main>", None) == body.strip()
    assert main_text(f'<article><p class="legal-text">{body}</p><p class="ad">buy</p></article>', None) == body.strip()
    assert main_text(f'<div class="story-ad-free legal"><p>{body}</p></div><div class="legal">terms</div>', None) == body.strip()
    assert main_text(f'<article><p>{body}</p></article><div class="comments"><p>{body * 3}</p></div>', None) == body.strip()


def test_signs_inside_words_and_attributes():
    assert main_text("<p>ex<wbr>treme<img src=x>ly<br>long</p>", None) == "extremely long"
    assert main_text("<p>Hello <span hidden>no</span> <b class=ad>no</b>world</p>", None) == "Hello world"
    long = "x>y" * 5000
    assert main_text(f"""<div data-json='{{"a": "{long}"}}'><p title="{long}">text</p></div>""", None) == "text"
    assert main_text("<p it's>one</p><p title=\"never closed>two</p>", None) == "one\ntwo"
    assert main_text("<p a='" + "b" * 20_000 + "'>t</p>" * 3, None).startswith("t")


def test_nine_and_ten_pages_alike():
    page = lambda n: f"<article><p>The only paragraph of the one article here</p></article><div class=x>advert {n}</div>"
    for count in (1, 3, 9, 10, 40):
        wrapper = page_expression(page(0))
        for n in range(1, count):
            wrapper = merged(wrapper, page_expression(page(n)))
        assert main_text(page(0), rules_of(wrapper)) == "The only paragraph of the one article here"


def test_the_wrapper_alone_finds_the_body(spark):
    bar = "".join(f'<a href="/{w}"><i>{w}</i> pages</a> ' for w in ("Home", "News", "About"))
    page = f"<body><div><a>Logo</a></div><div>{bar}</div><table><tr><td><p>Title {{n}}</p><p>{BODY}</p></td><td><p>Always this box</p></td></tr></table><div><p>Imprint and terms</p></div></body>"
    got = extracted(spark, [page.replace("{n}", str(n)) for n in range(3)])
    assert got == {n: f"Title {n}\n" + BODY.replace("{n}", str(n)) for n in range(3)}
    # copies of one page tell nothing, nor do adverts that change around a text that doesn't
    same = extracted(spark, [page.replace("{n}", "7")] * 5)
    assert all(BODY.replace("{n}", "7") in t for t in same.values())
    advert = extracted(spark, [page.replace("{n}", "7") + f"<div>buy {n}</div>" for n in range(5)])
    assert all(BODY.replace("{n}", "7") in t for t in advert.values())


def test_a_link_bar_inside_the_main_part_goes(spark):
    bar = "<div><a>Home</a> <b>News</b><a>About</a></div>"
    pages = [f"<main>{bar}<h1>Same title</h1><p>Body number {n}</p></main>" for n in range(12)]
    assert extracted(spark, pages) == {n: f"Same title\nBody number {n}" for n in range(12)}


@pytest.mark.parametrize("tag", ["div", "section", "blockquote", "b", "ul><li"])
def test_ten_thousand_levels(spark, tag):
    deep = f"<{tag}>" * 10_000 + "deep text"
    other = "<div>" * 3 + "other text" + "</div>" * 3
    assert extracted(spark, [deep, deep, other, None]) == {0: "deep text", 1: "deep text", 2: "other text", 3: ""}


def test_expressions_survive_storing():
    wrapper = merged(page_expression("<div><p>a</p><ul><li>b<li>c</ul></div>"), page_expression("<div><p>d</p></div>e"))
    assert unpacked_expression(packed_expression(wrapper)) == wrapper
