"""Main text: pages with known content."""

import html
import re

from stormrail.llm import main_text as m

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{{}}</style><script>var a = "</p>not this";</script></head>
<body class="page-with-header"><header class="site-header"><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, please accept all of them now.</div>
<div id="main"><{tag}><h1>The &eacute;legant title</h1><p>First   paragraph with <b>bo</b>ld&nbsp;words &amp; more
words in it.</p><p>Second <a href="/x">linked words</a> here.<br>After a break.</p>
<aside>Related things you may like to read</aside><form>Your mail <input name="m"></form>
<p>Third one &lt;not a tag&gt; ends.</p></{tag}></div>
<section class="comments"><p>What a nice article, I liked it very much indeed.</p><p>Me too, and more.</p></section>
<div class="sidebar"><p>Popular posts of the week are listed here</p></div>
<footer>&copy; 2020 Somebody, all rights reserved for ever</footer></body></html>"""
TEXT = ("The élegant title First paragraph with bold words & more words in it. Second linked words here. After a break. "
        "Third one <not a tag> ends.")


def test_article_with_and_without_weights():
    for tag in ("article", "div"):
        assert m.main_text(PAGE.format(tag=tag), {}) == TEXT


def test_learned_weights(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", PAGE.format(tag="article"), "x", 1) for i in range(20)] + [
        (50, "u", PAGE.format(tag="div"), "x", 1), (51, None, None, "x", 1), (52, "u", "", "x", 1),
        (53, "u", "<p>a < b", "x", 1), (54, "u", "plain words only", "x", 1), (55, "u", "<nav>menu", "x", 1),
        (56, "u", "<p>" + "long words " * 30_000, "x", 1), (None, "u", "<p>no id</p>", "x", 1), (None, "u", "<p>no id</p>", "x", 1)],
        "page_id long, url string, html string, page string, kind int")
    got = [(r.page, r.text, r.n_chars) for r in m.extract(pages).collect()]
    by = dict((k, t) for k, t, _ in got)
    assert len(got) == 29 and all(n == len(t) for _, t, n in got)
    assert all(by[i] == TEXT for i in [*range(20), 50])
    assert by[51] == by[52] == by[55] == "" and by[53] == "a < b" and by[54] == "plain words only" and by[None] == "no id"
    assert by[56] == ("long words " * 30_000).strip()
    assert m.extract(pages.filter("page_id > 1000")).count() == 0


def test_given_pages(spark, tables):
    got = {r.page: r.text for r in m.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for p in tables["pages"]:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        blocks = html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", ""))
        assert got[p["page_id"]] == " ".join(blocks.split())


ARTICLE = "<p>" + "good words of an article come here. " * 8 + "</p>"


def learned(spark):
    page = ("<html><body><header class='top-bar'><a href='/'>Site</a></header><div class='zone-left'><ul><li>some thing</li>"
            "</ul></div><article><h1>A title</h1>" + ARTICLE + "</article><div class='zone-bottom'>end of page</div></body></html>")
    df = spark.createDataFrame([(i, f"u{i}", page) for i in range(30)], "page_id long, url string, html string")
    return m.learn(df), page


def test_weights_come_from_labelled_pages(spark):
    """Names that no list has are told apart by what labelled pages say, with the lists switched off."""
    weights, page = learned(spark)
    assert weights[".zone"] < -1 and weights[".bottom"] < -1 and weights["p"] > 1
    want = ("A title " + "good words of an article come here. " * 8).strip()
    assert m.main_text(page, weights, lists=False) == want
    assert m.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>"), weights, lists=False) == want
    assert m.main_text(page, {}, lists=False) != want


def test_the_run_leaves_out_what_scores_positive_elsewhere(spark):
    weights, _ = learned(spark)
    page = "<body><p>stray words</p>" + "<div class='zone-left'>many more words of no use at all here</div>" * 3 + ARTICLE + "</body>"
    assert m.main_text(page, weights) == ("good words of an article come here. " * 8).strip()


def test_frames_and_heads_are_no_boxes(spark):
    body = ("good words of an article come here. " * 16).strip()
    for weights in ({}, learned(spark)[0]):
        two = ARTICLE + ARTICLE
        assert m.main_text(f"<body><form id='aspnetForm'><div>{two}</div></form></body>", weights) == body
        assert m.main_text("<body><nav>menu</nav><div class='content-sidebar-wrap'><article>" + two
                           + "</article><div class='sidebar'>other</div></div></body>", weights) == body
        assert m.main_text(f"<article><div class='post-header'><h1>Head</h1></div>{two}</article>", weights) == "Head " + body
        assert m.main_text("<body><article><p>Few.</p></article><footer>" + "many words of a footer " * 9 + "</footer></body>",
                           weights) == "Few."


def test_deep_nesting_takes_time_in_proportion():
    import time
    took = []
    for n in (5_000, 50_000):
        began = time.time()
        assert m.main_text("<span>x " * n, {}) == ("x " * n).strip()
        m.main_text("<div>x</b></i> " * n, {})
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 1


def test_best_run_is_the_largest_sum():
    import random
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        lo, hi = m.best_run(x)
        sums = [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        assert sum(x[lo:hi]) == max([0, *sums])
