import itertools
import random
import re
import time
from html import unescape

import pytest

from wayfowl.llm import mincut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<div id="cookie-consent">We use cookies to make this site better for you. <button>OK</button></div>
<header><h1>My Site</h1><p>All the news that we could find today, and more of it tomorrow.</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav>
<main><div class="post-content"><h2>A  &amp; B</h2><p>First paragraph with <a href="x">a link</a> in it.<br>Next line.
<p>Short one.</p><div class="ad-box"><p>Buy this splendid thing now, it is cheap and it is very good.</p></div>
<ul><li>A point that is made</li><li>Another point</li></ul><table><tr><td>cell one<td>cell two</table>
<script>var t = "</p>";</script><p>Last&nbsp;words &lt;here&gt;.</p></div>
<section id="comments"><article class="comment"><p>I liked this article a lot, thank you for writing it, truly.</p></article></section></main>
<aside><p>Popular stories that you may like to read when you have the time.</p></aside>
<form><p>Sign up for our letter and get it every single morning.</p></form>
<footer>&copy; 2024 Us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert mincut.main_text(PAGE).split("\n") == ["A & B", "First paragraph with a link in it. Next line.", "Short one.", "A point that is made", "Another point", "cell one", "cell two", "Last words <here>."]


BODY = "<h1>A heading of the page</h1><p>First paragraph of the text, which has a number of words in it.</p><p>Second paragraph, and this one has quite a few words as well, so it is text.</p>"
SIDE = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of the day</a></li></ul>"
TEXT = ["A heading of the page", "First paragraph of the text, which has a number of words in it.", "Second paragraph, and this one has quite a few words as well, so it is text."]


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body>{BODY}</body></html>",  # no end of the head
        f"<title>T</title>{BODY}",  # no html, head or body at all
        f"<html><body><div class='layout has-sidebar'><article>{BODY}</article><div class='sidebar'>{SIDE}</div></div></body></html>",
        f"<body><div id='sidebar-right'><article>{BODY}</article></div></body>",
        f"<body><article><div class='article-header'>{BODY[: BODY.index('<p>')]}</div>{BODY[BODY.index('<p>') :]}</article></body>",
        f"<body><article><header class='masthead'>{BODY[: BODY.index('<p>')]}</header><div class='entry-content'>{BODY[BODY.index('<p>') :]}</div></article></body>",
        f"<body><form method='post' action='./p.aspx' id='aspnetForm'><div id='nav'>{SIDE}</div><div id='content'>{BODY}</div><div class='footer'><p>All rights reserved by us, and by nobody else.</p></div></form></body>",
        f"<body><div>{BODY}</div><svg><path d='m0'><div class='comments'><h3>Comments</h3><p>I have read this and I do not think that it is right at all.</p></div>",
        f"<body><select><option>One<option>Two</select>{BODY}<object data='x'><script>if (a < b) document.write('<!-- <p>no</p>');</script>",
        f"<body><div class='main'>{BODY}</div><div id='comments'><article class='comment'><p>{'What a long comment this is, and nobody asked for it. ' * 9}</p></article></div></body>",
        f"<BODY><DIV CLASS=post>{BODY}</DIV><NAV>{SIDE}</NAV></BODY>",
    ],
)
def test_pages_that_are_not_as_the_textbook_has_them(html):
    assert mincut.main_text(html).split("\n") == TEXT


MORE = "<p>What follows here is one more paragraph of the article, as long as the others are.</p>"
LONG = " ".join(f"Sentence {i} of a long section says what there is to say about its subject." for i in range(6))


@pytest.mark.parametrize(
    "part, text",
    [
        ("<h2 id='privacy'>Privacy at work</h2>", ["Privacy at work"]),
        ("<h2 id='related-work'>Related work</h2>", ["Related work"]),
        ("<h2 id='comments'>Comments on the draft</h2>", ["Comments on the draft"]),
        ("<section id='discussion'><h2>Discussion</h2><p>We saw that it works well.</p></section>", ["Discussion", "We saw that it works well."]),
        (f"<section class='discussion'><p>{LONG}</p></section>", [LONG]),
        ("<div class='share-price-table'><table><tr><td>Monday<td>12.5</table></div>", ["Monday", "12.5"]),
        ("<div class='notice-board'><p>The board hangs beside the door of the hall, where all can read it.</p></div>", ["The board hangs beside the door of the hall, where all can read it."]),
        ("<section id='cookies'><h2>Cookies from the oven</h2><p>Bake them for ten minutes.</p></section>", ["Cookies from the oven", "Bake them for ten minutes."]),
        ("<div class='notice'><p>We have changed the terms of our service.</p></div>", []),
        ("<div class='share'><h4>Share this</h4><a href='/f'>One place</a> <a href='/t'>Another place</a></div>", []),
        ("<div class='related'><h3>Related</h3><ul><li><a href='/1'>A story of the day</a><li><a href='/2'>Another story</a></ul></div>", []),
        ("<div class='ad-leaderboard'><p>Buy this splendid thing now, it is cheap and it is very good.</p></div>", []),
        (f"<div class='comments'><h2>Comments</h2><p>{LONG}</p></div>", []),
        ("<div class='newsletter-signup'><h3>Newsletter</h3><p>Sign up for our letter and get it every single morning.</p></div>", []),
    ],
)
@pytest.mark.parametrize("around", ["article", "div class='entry-content'"])
def test_names_within_an_article(part, text, around):
    html = f"<body><nav>{SIDE}</nav><{around}>{BODY}{part}{MORE}</{around.split()[0]}></body>"
    assert mincut.main_text(html).split("\n") == [*TEXT, *text, re.sub("<[^>]*>", "", MORE)]


def test_names_around_a_page():
    body = BODY.replace("h1>", "h2>")
    footer = "<div class='footer'><p>All rights reserved by us, and by nobody else, in this year too.</p></div>"
    for name in ("page sidebar-right", "nav-left", "layout sidebar"):
        html = f"<body><div class='{name}'><div class='menu'>{SIDE}</div><div>{body}</div>{footer}</div></body>"
        assert mincut.main_text(html).split("\n") == TEXT, name
    assert mincut.main_text(f"<body><div class='comments'><h2>Comments</h2><p>{LONG}</p></div></body>") == ""
    assert mincut.main_text(f"<body><div class='page'>{body}<div class='comments'><h2>Comments</h2><p>{LONG}</p><p>{LONG}</p></div></div></body>").split("\n") == TEXT


def test_what_stands_beside_the_article():
    column = "<div><p>Buy this splendid thing now, it is cheap and it is very good.</p></div>"
    reader = f"<div><b>Ann</b><p>{LONG}</p></div><div><b>Ben</b><p>I have read this and I do not think that it is right at all.</p></div>"
    for around in ("article", "main"):
        assert mincut.main_text(f"<body><{around}>{BODY}{MORE}</{around}>{column}{reader}</body>").split("\n") == [*TEXT, re.sub("<[^>]*>", "", MORE)]
    assert mincut.main_text(f"<body><div>{column[5:-6]}</div><article>{BODY}{MORE}</article></body>").split("\n")[-4:] == [*TEXT, re.sub("<[^>]*>", "", MORE)]
    # a heading above the article belongs to it; parts of the text in several articles are all text
    head, rest = BODY.split("</h1>")
    assert mincut.main_text(f"<body><div>{head}</h1></div><article>{rest}</article></body>").split("\n") == TEXT
    assert mincut.main_text(f"<body><article>{BODY}</article><article>{MORE}</article></body>").split("\n")[:3] == TEXT


def test_work_is_in_proportion_to_the_page():
    def seconds(n):
        deep = "<div><section>" * n + BODY + "</article></nav></li>" * n + "</section></div>" * n + "<svg>" * n + "<li>" * n
        start = time.process_time()
        assert mincut.main_text(deep).split("\n") == TEXT
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 10


def test_flow_finds_the_least_cut():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 8)
        score = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(kept, score=score, edges=edges):
            return sum(max(0, s) for s, k in zip(score, kept) if not k) + sum(max(0, -s) for s, k in zip(score, kept) if k) + sum(c for a, b, c in edges if kept[a] != kept[b])

        got = mincut.min_cut([max(0, s) for s in score], [max(0, -s) for s in score], edges)
        assert abs(cost(got) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


def test_all_pages_have_their_article(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in mincut.op3_html_min_cut(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " " if b.startswith("<br") else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|div|article)[^>]*>", article)]
        assert got[r.page_id].text == "\n".join(w for w in want if w), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "", 1), (2, "u", "<p>" + "word " * 60_000 + "</p>", 1), (2, "u", "<div", 1), (3, "u", "<p>a<p>b<<>>" * 2000, 1), (4, "u", "<nav><a href='x'>only</a></nav>", None)]
    got = mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 6
    by = {(r.page_id or 0): r for r in got if r.page_id != 2}
    assert by[1].text == by[0].text == by[4].text == "" and max(r.n_chars for r in got if r.page_id == 2) == 299_999
    assert mincut.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
