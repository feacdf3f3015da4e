"""HTML extraction on pages whose article is known."""

import re

import numpy as np

from driftloom.llm import html_text as H

WRAP = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>%s<footer>&copy; site</footer></body></html>'


def test_article_of_a_page():
    body = '<div class="ad">Buy!</div><!-- note --><article><h1>A &amp; B</h1><p>One <b>bold</b>\n\t word&nbsp;here.<br><p>Two &lt;three&gt;</p><aside>side</aside><form><p>mail</p></form><p>Four</p></article><div id="comments"><p>Nice!</p></div>'
    assert H.main_text(WRAP % body) == "A & B\n\nOne bold word here.\n\nTwo <three>\n\nFour"


def test_regions_inside_the_article():
    body = '<article><header><h1>Head</h1></header><p>Text</p><section class="comments"><p>Reader</p></section><div class="cookieNotice">Accept</div><div class="share-bar">Share</div><p hidden>x</p><p>End</p></article>'
    assert H.main_text(WRAP % body) == "Head\n\nText\n\nEnd"


def test_unclosed_tags():
    body = "<article><p>One <b>bold<br><p>Two<i> it<p>Three</article><div>after</div>"
    assert H.main_text(WRAP % body) == "One bold\n\nTwo it\n\nThree"


def test_clusters_without_an_article():
    links = "".join(f'<div><a href="/{i}">w{i}</a></div>' for i in range(12))
    text = [f"Paragraph {i} " + "with a long line of plain text " * 6 for i in range(6)]
    page = WRAP % (links + "".join(f"<p>{t}</p>" for t in text) + links)
    assert H.main_text(page) == "\n\n".join(t.strip() for t in text)


def test_smoothing_keeps_single_cluster():
    assert H.content_lines(np.array([5.0])).all()
    assert H.content_lines(np.array([3.0, 3.0, 3.0])).all()


def test_empty_broken_and_long_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<p", "x"), (3, "u", "plain words", "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<p>" + "w " * 200_000, "x"), (7, "u", "<script>only", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.text, r.n_chars) for r in H.extract(pages).collect()]
    assert got[0] == got[1] == got[6] == ("", 0)
    assert got[3] == ("plain words", 11) and got[4][0] == "deep" and got[5][1] == 399_999
    assert H.extract(pages.limit(0)).count() == 0


def test_pages_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.op10_html_text(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        import html

        assert r.text == "\n\n".join(html.unescape(x) for x in want if x)
        assert r.n_chars == len(r.text)
