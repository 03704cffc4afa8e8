import html
import itertools
import re

import numpy as np

from shelfmark.llm.htmltext import extract, fit, main_text
from shelfmark.llm.mincut import source_side


def test_cut_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = 6
        a, b = rng.random(n) * 2, rng.random(n) * 2
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep, a=a, b=b, edges=edges):
            return sum(b[i] if k else a[i] for i, k in enumerate(keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])

        best = min(cost(k) for k in itertools.product([False, True], repeat=len(a)))
        assert abs(cost(source_side(a.tolist(), b.tolist(), edges)) - best) < 1e-9


def test_pages_give_their_articles(small):
    pages = small["pages"].collect()
    out = {r.page_id: r for r in extract(small["pages"]).collect()}
    for page in pages:
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert out[page.page_id].text == expected and out[page.page_id].n_chars == len(expected) and out[page.page_id].url == page.url


PAGE = """<!doctype html><html><head><title>T</title><script>var x="<p>no</p>";</script><style>p{}</style></head>
<body class="with-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div>
<nav><ul><li><a href=a>Home</a><li><a href=b>More</a></ul></nav>%s<aside>Side</aside><form><label>Name</label><input></form>
<section id="comments"><article><p>I disagree, dear sir.</p></article></section><footer>&copy; 2020</footer></body></html>"""
BODY = """<h2>Title &amp; more</h2><p>First   paragraph with <b>bold</b>, and a <a href=x>link</a>&nbsp;here.
<p>Second one<br>in two lines; it has many words and ends well.</p><div class="ad">Buy now</div><script>bad()</script><p>Last.</p>"""
TEXT = "Title & more First paragraph with bold, and a link here. Second one in two lines; it has many words and ends well. Last."


def test_boilerplate_goes_with_and_without_article_tags(small):
    weights = fit([r.html for r in small["pages"].collect()])
    for wrapped in (f"<article>{BODY}</article>", f'<div id="main"><main>{BODY}</main></div>', f'<div class="content">{BODY}</div>'):
        assert main_text(PAGE % wrapped, weights) == TEXT


def test_headers_and_state_words(small):
    weights = fit([r.html for r in small["pages"].collect()])
    article = f'<article class="post"><header class="entry-header"><h1>Head line</h1></header>{BODY}</article>'
    assert main_text(PAGE % article, weights) == "Head line " + TEXT
    assert main_text(PAGE % f'<div class="content has-sidebar no-comments">{BODY}</div>', weights) == TEXT
    assert main_text(PAGE % f'<div class="sidebar">{BODY}</div><main>{BODY}</main>', weights) == TEXT


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, blocks int"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a"), (3, "u", "<p>a"), (4, "u", "<article>" + "<p>x y.</p>" * 20_000 + "</article>"),
            (5, "u", "<<<>&&#x;<p <p> </q> <!-- "), (6, "u", "<script>" * 500 + "<div>" * 3000), (7, "u", "<a href='x" * 2000)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], schema)
    out = extract(frame).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[4].text == " ".join(["x y."] * 20_000)
    assert extract(frame.limit(0)).count() == 0
