"""Articles that marks on a page must not lose."""

from driftloom.llm import html_text as H

LONG = ["Paragraph %d " % i + "with a long line of plain text " * 6 for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in LONG)
WANT = "\n\n".join(t.strip() for t in LONG)


def test_omitted_end_of_head():
    assert H.main_text(f"<html><head><title>t</title><meta charset=x><body><article>{BODY}</article></body></html>") == WANT
    assert H.main_text(f"<html><head><title>t</title><style>p{{}}</style><article>{BODY}</article>") == WANT


def test_words_never_drop_an_article_or_most_of_the_text():
    aside = '<div class="comments"><p>Nice!</p></div>'
    for mark in ("class='layout has-sidebar'", "id='no-comments'"):
        assert H.main_text(f"<body><div {mark}><article>{BODY}</article>{aside}</div></body>") == WANT
        assert H.main_text(f"<body><section {mark}>{BODY}</section>{aside}</body>") == WANT
    assert H.main_text(f"<body><article>{BODY}{aside}<div class='share'>Share</div></article></body>") == WANT


def test_teaser_is_not_the_page():
    page = f"<body><article><p>Teaser</p></article><div>{BODY}</div></body>"
    assert WANT in H.main_text(page)


def test_math_in_an_article():
    assert H.main_text("<article><p>So <math><mi>x</mi></math> is one</p></article>") == "So x is one"


def test_unclosed_head_inside_hidden_text_stays_hidden():
    assert H.main_text("<head><script>var x = '<p>'</script><title>only a title</title>") == ""


def test_words_of_a_wrapper_keep_its_text():
    page = '<body><div id="page" class="site has-sidebar"><p>%s</p></div></body>'
    assert H.main_text(page % "One short line") == "One short line"
    assert H.main_text('<body><div class="post no-comments"><h1>Head</h1><p>Some text</p></div></body>') == "Head\n\nSome text"


def test_white_space_of_any_kind_is_one_space():
    assert H.main_text("<p>a\u2003b\u2028c\u3000\x85d&nbsp;e \u2009f</p>") == "a b c d e f"


def test_long_comments_and_adverts_go_by_prior_and_ratio():
    comment = "<div class='comments'><p>" + "I think that this is a long reader comment about it. " * 3 + "</p></div>"
    assert H.main_text(f"<body><article>{BODY}{comment}</article></body>") == WANT
    assert H.main_text(f"<body><div>{BODY}</div>{comment}<div class='ad-box'>Buy one now</div></body>") == WANT


def test_clusters_decide_pages_without_any_mark(sf):
    """Pages of the table with their article and advert marks taken off: the same text from ratios alone, on most."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>").replace(' class="ad"', "") for p in pages]
    same = sum(H.main_text(a) == H.main_text(b) for a, b in zip(bare, pages))
    assert same >= 0.8 * len(pages)


def test_ratios_decide_every_page(sf, monkeypatch):
    import pyarrow.parquet as pq

    asked, threshold = [], H.cluster_threshold
    monkeypatch.setattr(H, "cluster_threshold", lambda smooth: asked.append(len(smooth)) or threshold(smooth))
    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    assert all(H.main_text(p) for p in pages) and len(asked) == len(pages)


def test_deep_and_broken_pages_take_linear_time():
    assert H.main_text("<div>" * 60_000 + "deep") == "deep"
    assert len(H.main_text("<div>x</b></section>" * 20_000)) > 0
