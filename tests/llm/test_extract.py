import html
import itertools
import random
import re

from mirrorlake.llm import extract


def test_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 10)
        odds = [rnd.choice([0, rnd.uniform(-3, 3)]) for _ in range(n)]
        tied, ties = [-1] + [rnd.randrange(k) for k in range(1, n)], [0] + [rnd.uniform(0, 2) for _ in range(1, n)]
        cost = lambda keep: sum(max(0, x) if not k else max(0, -x) for x, k in zip(odds, keep)) + sum(ties[k] for k in range(1, n) if keep[k] != keep[tied[k]])  # noqa: E731, B905, B023
        assert abs(cost(extract.tree_cut(odds, tied, ties)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


def flips(page):
    """Blocks whose label the cut turns against their own odds: (brought in, taken out)."""
    found, tied, ties = extract.blocks(page)
    odds = [0.0] * len(tied)
    for _, x, at in found:
        odds[at] = x
    keep = extract.tree_cut(odds, tied, ties)
    return [t for t, x, at in found if keep[at] and x <= 0], [t for t, x, at in found if not keep[at] and x > 0]


def test_the_cut_decides_where_a_block_alone_would_not():
    text = " ".join(f"word{k}" for k in range(40)) + "."
    page = f"<body><div><p>{text}</p><div>Figure 3</div><p>{text}</p><div>* * *</div><p>{text}</p></div></body>"
    assert flips(page) == (["Figure 3", "* * *"], [])
    assert extract.main_text(page) == f"{text}\nFigure 3\n{text}\n* * *\n{text}"
    menu = "".join(f"<div><a href='/{k}'>Section {k}</a></div>" for k in range(4))
    page = f"<body><article><p>{text}</p></article><div><div>{menu}</div><div>Choose one of these here.</div><div>{menu}</div></div></body>"
    assert extract.main_text(page) == text
    # a paragraph whose class sounds like boilerplate is held by its neighbours, a short one is not
    named = " ".join(f"part{k}" for k in range(30)) + "."
    page = f'<body><article><p>{text}</p><p class="legal reader">{named}</p><p>{text}</p><p class="share">Share it.</p><p>{text}</p></article></body>'
    assert extract.main_text(page) == f"{text}\n{named}\n{text}\n{text}"
    assert flips(page)[0] == [named]


def test_pages_without_an_article_element(spark):
    """The pages of the table with their article, main and body words taken away."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = 0
    for page in pages:
        bare = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page)
        same += extract.main_text(bare) == extract.main_text(page)
    print(same, len(pages))
    assert same >= 0.9 * len(pages)


def test_broken_heads_quotes_and_article_headers():
    text = "A plain paragraph of some words that is the text of this page, and nothing more."
    assert extract.main_text(f"<html><head><title>T</title><meta charset=x><p>{text}</p>") == text
    assert extract.main_text(f'<body><article><p>{text}</p><p><a href="x>Here</a> is more of it, all in one line, as it should be.</p></article></body>').startswith(text)
    assert "href" not in extract.main_text(f'<body><article><p>{text}</p><p><a href="x>Here</a> is more of it.</p></article></body>')
    page = f'<body><div class="header">Site</div><article><div class="header"><h1>The title of it</h1></div><p>{text}</p></article></body>'
    assert extract.main_text(page) == f"The title of it\n{text}"


def test_long_pages_take_time_in_proportion():
    import time

    took = []
    for n in (4000, 16000):
        page = "<body>" + "".join(f"<div><p>word {k} and some more of them.</p><div><a href=x>menu</a></div></div>" for k in range(n)) + "</body>"
        began = time.perf_counter()
        extract.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies, as many sites do, and so on.</div>
<main><article><header><h1>The  title &amp; more</h1></header><p>First <b>bold</b>&nbsp;text here.<br><p>Short.
<div class="ad-slot">Buy this now, it is a very good thing to buy.</div><p>Last one, with <a href="x">a link</a> in it.</p>
<form><p>Write to us.</p><input name="q"></form></article>
<section id="comments"><p>I read all of this and I think it is a long and thoughtful remark by a reader.</p></section></main>
<aside><p>Other stories that you may like to read some day.</p></aside><footer>&copy; us</footer><script>var x = "<p>no</p>";</script></body>"""


def test_article_without_the_rest():
    assert extract.main_text(PAGE) == "The title & more\nFirst bold text here.\nShort.\nLast one, with a link in it."
    assert extract.main_text("<p>Only a paragraph of plain words that stands alone on its page.") == "Only a paragraph of plain words that stands alone on its page."
    assert extract.main_text("<script>never closed <p>x") == ""


def test_tables_pages_equal_their_articles(spark):
    got = extract.query(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h\d)\b[^>]*>", inner)]
        assert r.text == "\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None, "a"), (None, "u", "", "a"), (2, "u", "<p>" + "word " * 50000, "a"), (2, "u", "<p>" + "word " * 50000, "a")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 249999), (2, 249999)]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_around_the_article_do_not_lose_it():
    text = " ".join(f"word{k}" for k in range(200)) + "."
    for page in (
        '<body class="right-sidebar"><article><p>{}</p></article></body>',
        '<body><div class="layout with-sidebar"><article><p>{}</p></article><div class="sidebar"><p>More to see over here.</p></div></div></body>',
        '<body><article class="post has-comments"><p>{}</p></article></body>',
        '<body><main id="content" class="no-sidebar"><div class="share-box">Share this.</div><p>{}</p></main></body>',
        '<body class="has-header"><div class="layout with-sidebar"><p>{}</p><div class="sidebar"><p>More to see over here.</p></div></div></body>',
        '<body><article><div class="reader-text"><p>{}</p></div><p class="share">Share it.</p></article></body>',
        '<body><article><p>{}</p></article><div id="comments"><article class="comment"><p>I think so too, well said by them.</p></article></div></body>',
    ):
        assert extract.main_text(page.format(text)) == text, page
    remark = "<p>I read all of this and I think it is a long and thoughtful remark by a reader.</p>"
    assert extract.main_text(f'<body><main><article><p>{text}</p></article><section id="comments">{remark * 40}</section></main></body>') == text
    # a long part is worth more than its name
    two = f'<body><article><p>{text}</p><div class="related-work"><p>{text}</p></div></article></body>'
    assert extract.main_text(two) == f"{text}\n{text}"
