import html as H
import re

import pandas as pd
import pytest

from causeway.llm import htmltext as X


def article(page):
    """Text of the only article of a page as the test tables have it: block tags part words, others don't."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|br|h1|div|ul|li)\b[^>]*>", " ", inner)
    return " ".join(H.unescape(re.sub(r"<[^>]+>", "", inner)).split())


def test_all_pages_of_the_test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in X.main_text(pages).collect()}
    rows = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    assert len(got) == len(rows)
    for i, h in zip(rows["page_id"], rows["html"], strict=True):
        assert got[i].text == article(h)
        assert got[i].n_chars == len(got[i].text)


NOISE = """<header class="site"><h1>Site name here</h1></header><nav><a href=/>Home</a> lots of words in the menu of this page</nav>
<div class="cookie-notice">We use cookies on this site and you may accept them now or later</div><aside>Side words that nobody reads at all</aside>
<form action=/><label>Name</label><input name=q><button>Send it</button></form><noscript>turn it on</noscript>"""
AFTER = """<section id="comments"><p>First reader says a lot of words here, more than the article itself has, which is quite a lot of words. </p></section>
<div class="sidebarLeft">left</div><div style="display: none">hidden words</div><footer>Imprint and many other words <p>in the footer</footer>"""


@pytest.mark.parametrize(
    "body, want",
    [
        ('<div class="post-12"><p>One &amp; two.</p><p>Three<b>four</b>  five<br>six</p></div>', "One & two. Threefour five six"),
        ('<main><article><header><h1>Title</h1></header><section><p>Text one.</section><section><p>Text two.</section></article></main>', "Title Text one. Text two."),
        ("<article><p>a &lt;b&gt; &eacute;&#233;&nbsp;c<!-- not this --></p><script>if (a</b) '</p>'</script><p data-x='>'>d</article>", "a <b> éé c d"),
        ('<article><p>Words <a href="x">with a link</a> in them</p><div class="ad">Buy</div><ul><li>one<li>two</ul></article>', "Words with a link in them one two"),
        ('<table><tr><td><p>Cell text</td><td>more</td></tr></table>', "Cell text"),
        ('<article><div class="header-note">Shadowed loading address</div><p>Rest</p></article>', "Shadowed loading address Rest"),
        ("<ARTICLE><P>Upper case tags</P></ARTICLE>", "Upper case tags"),
    ],
)
def test_noise_goes(body, want):
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style></head><body>{NOISE}{body}{AFTER}</body></html>"
    text, path = X.extract(page, [])
    if body.startswith("<table"):
        assert text.startswith(want)
    else:
        assert text == want


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain words", "plain words"), ("<", "<"), ("<p>a<p", "a<p"), ("<script>x", ""), ("<div><div><p>a</div>b", "a b"), ("&amp;amp;", "&amp;"), ("<html><body></body></html>", "")])
def test_odd_pages(page, want):
    assert X.extract(page, [])[0] == want


def test_very_long_page():
    page = "<article>" + "<p>word <i>x</i></p>" * 100_000 + "<div " * 2000 + '"' + "</article>"
    assert X.extract(page, [])[0].startswith("word x word x")


def test_host_consensus_overrules_one_page(spark):
    """One page has more text in a box than in its article; the host's other pages tell which is which."""
    page = lambda a, b: f'<html><body><div class="story-1"><p>{"story " * a}</p></div><div class="box"><p>{"box " * b}</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", page(50, 5), "x") for i in range(10)] + [(10, "http://h.example/10", page(40, 60), "x"), (11, "http://other.example/1", page(4, 60), "x"), (12, None, None, "x"), (12, None, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in X.main_text(df).collect()}
    assert set(got[10].split()) == {"story"} and set(got[11].split()) == {"box"} and got[12] == ""
    assert X.main_text(df).count() == 14 and X.main_text(df.limit(0)).count() == 0


def test_joined_winners_are_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = sorted(map(tuple, X.main_text(pages).collect()))
    monkeypatch.setattr(X, "MAX_BROADCAST", -1)
    assert sorted(map(tuple, X.main_text(pages).collect())) == one


STORY = "<article><p>" + "Some words stand here, and more. " * 10 + "</p></article>"


@pytest.mark.parametrize("name", "layout has-sidebar|page no-comments|content-with-sidebar|social-science|search-results|share-price|post replies-open|nav-collapsed wrapper|header-fixed|comments|sidebar|cookie".split("|"))
def test_marking_words_never_cut_what_holds_the_article(name):
    assert X.extract(f'<html><body><div class="{name}">{STORY}</div></body></html>', [])[0] == " ".join(("Some words stand here, and more. " * 10).split())


@pytest.mark.parametrize("name, marked", [("notice-board", False), ("notice", True), ("cookie-notice-bar", True), ("siteSidebar", True), ("sidebarLeft", True), ("has-sidebar", False), ("ad-slot-3", True), ("adult", False), ("nav", True), ("header", False), ("", False)])
def test_marks(name, marked):
    assert X.marks(name, X.MARKED) == marked


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>One thing.</p><section class="notice-board"><p>board text</p></section></article>', "One thing. board text"),
        ("<body><nav><ul><li><a href=x>Menu</a></ul><div><p>" + "prose here, " * 20 + "</p></div></body>", "prose here, " * 20),
        ("<body><nav><a href=x>Menu</a> <p>" + "prose here, " * 20 + "</p></body>", "prose here, " * 20),
        ("<body><form action=/><div>" + "prose here, " * 20 + "</div></form></body>", "prose here, " * 20),
        ('<article><p>Text</p></article><ol class="comment-list"><li><article class="comment-body"><p>' + "reader words, " * 50 + "</p></article></li></ol>", "Text"),
        ("<article><p>a<script>b()</script>c <span class=ad>buy <span>now</span> here</span>d</p></article>", "ac d"),
        ("<article><ul class=menu><li>x<ul><li>y</ul></ul><p class=ad>Buy<p>Text</article>", "Text"),
    ],
)
def test_broken_and_misnamed_pages(page, want):
    assert X.extract(page, [])[0] == want.strip()


def test_a_second_block_stays():
    say = lambda k, w: f"{w} sentence is here. " * k
    page = f'<body><div class="a"><p>{say(10, "First")}</p></div><div class="b"><p>{say(9, "Second")}</p></div><div class="c"><p>short</p></div></body>'
    for winners, losers, n in (([], [], 9), (["body>div.a"], [], 9), (["body>div.a"], ["body>div.b"], 0), (["body>div.zzz"], [], 9)):
        text = X.extract(page, winners, losers)[0]
        assert (text.count("First"), text.count("Second"), text.count("short")) == (10, n, 0)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "text" + "</div>" * 100_000, "<div>" * 100_000 + "text", '<a "' * 250_000, '<a "' * 250_001 + ">", "<a '\">" * 100_000, ("<nav>" + "word " * 40) * 20_000, "<div>" * 50_000 + "</section>" * 50_000, "<div " + "a" * 1_000_000 + ">x", "<" * 1_000_000, "<title>" * 100_000, "<div><p>x y</p></div>" * 50_000, "<p class=ad>" * 50_000],
)
def test_hostile_pages_take_time_in_proportion(page):
    import time

    start = time.process_time()
    X.extract(page, [])
    assert time.process_time() - start < 10


def plain_consensus(pages):
    """host -> (winners, losers) with dictionaries."""
    seen, chosen, score, total = {}, {}, {}, {}
    for url, html in pages:
        host = (re.match(r"[a-z]+://([^/:?#]*)", url or "") or [None, ""])[1]
        given = X.vote(html)
        total[host] = total.get(host, 0) + bool(given)
        for path, yes, s in given:
            k = host, path
            seen[k], chosen[k], score[k] = seen.get(k, 0) + 1, chosen.get(k, 0) + yes, score.get(k, 0) + s
    out = {}
    for host in total:
        mine = [k for k in seen if k[0] == host]
        won = [k[1] for k in sorted(mine, key=lambda k: (-chosen[k], -score[k], k[1])) if chosen[k] >= 0.1 * total[host] and chosen[k] >= 0.5 * seen[k]]
        lost = [k[1] for k in mine if chosen[k] < 0.5 * seen[k] and seen[k] >= 2 and seen[k] >= 0.1 * total[host]]
        out[host] = won, sorted(lost) if won else []
    return out


def test_equals_plain_consensus(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(120):
        boxes = "".join(f'<div class="{r.choice(["story", "box", "aside-text", "extra"])}{r.choice(["", "-1"])}"><p>{"word " * r.choice([2, 5, 30, 60])}</p></div>' for _ in range(r.randint(0, 4)))
        rows.append((i, f"http://h{r.randint(0, 3)}.example/{i}", f"<html><body>{boxes}</body></html>"))
    want = plain_consensus([(u, h) for _, u, h in rows])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {x.host: (list(x.winners), list(x.losers)) for x in X.consensus(df).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}
    texts = {x.page_id: x.text for x in X.main_text(df).collect()}
    for i, u, h in rows:
        assert texts[i] == X.extract(h, *want[re.match(r"http://([^/]*)", u)[1]])[0]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://h/1", "<p>a</p>", 1, "z", "w")], "page_id long, url string, html string, id int, host string, winners string")
    assert [tuple(x)[:4] for x in X.main_text(df).collect()] == [(1, "http://h/1", "a", 1)]
