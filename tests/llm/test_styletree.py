import math
from collections import Counter

import pytest

from sluice.llm import styletree


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>a <b>b</b>\n\t c&amp;d &#233;&nbsp;x</p>", "a b c&d é x"),
    (page("<nav><ul><li><a href=/x>menu</a></ul></nav><article><h1>Title</h1><p><b>One<br><p>two</p></article><footer>&copy; f"), "Title\nOne\ntwo"),
    (page("<div class='ad'>buy</div><div class='text'><p>x</p></div><aside>s</aside><form>f<input></form><div id=comments>c</div>"), "x"),
    (page("<script>var t='</p><p>no';</script><p>yes</p><!-- <p>no</p> --><noscript>no</noscript>"), "yes"),
    (page("<header>top</header><main><header><h1>In</h1></header><p>x</p><div class='share'>s</div></main>"), "In\nx"),
    (page("<p>a</p><p title=\"x > y\">b</p><p>1 < 2 & 3</p>"), "a\nb\n1 < 2 & 3"),
    (page("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>"), "a\nb\nc\nx\ny"),
    (page("<div hidden>h</div><div style='display: none'>h</div><div role=navigation>n</div><p>ok</p>"), "ok"),
    ("<article>a</article><article>b</article><p>outside", "a\nb"), ("<p>open <b", "open"), ("<p class=\"x>broken</p><p>b</p>", "broken\nb"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_pages_alone(html, text):
    assert styletree.extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body class='single no-sidebar'><div class=ad>buy</div><p>x</p></body>", "x"), ("<body class=menu><p>x</p></body>", "x"),
        ("<article class='post has-sidebar related'><div class='entry-header'><h1>T</h1></div><p>x</p></article>", "T\nx"), ("<main id=comments><p>x</p></main>", "x"),
        ("<div class='content related-none'><p>x</p></div>", "x"), ("<div class=widget><p>all there is</p></div>", "all there is"), ("<div class=widget-3>w</div><p>x</p>", "x"),
    ],
)
def test_names_of_the_page_drop_no_text(html, text):
    assert styletree.extract(html) == text


def test_deep_and_long_pages():
    assert styletree.extract("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(styletree.extract(page("<p>" + "word " * 200_000 + "</p>"))) == 999_999
    assert styletree.extract("<" * 5000 + "a" + '"' * 3000) == "<" * 4999  # a tag that never ends


def site(n, mark=True):
    for k in range(n):
        text = f"<p>story {k}</p><p>more {k * k}</p>"
        inner = f"<article>{text}</article>" if mark else f"<div class=story>{text}</div>"
        yield k, f"http://site.example/{k}", page(f"<div class=strip>Read our rules</div>{inner}<div class=tail>All rights of {k % 2}</div>")


@pytest.mark.parametrize("mark", [True, False])
def test_branches_that_read_alike_are_cut(spark, mark):
    rows = [*site(20, mark), (100, "http://other.example/", page("<div class=strip>Read our rules</div><p>x</p>"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in styletree.main_text(df).collect()}
    assert got == {k: f"story {k}\nmore {k * k}" for k in range(20)} | {100: "Read our rules\nx"}


def test_importance_by_definition(spark):
    df = spark.createDataFrame(list(site(12)), "page_id long, url string, html string")
    seen = {}
    for _, _, html in site(12):
        for p, a, b in styletree.features(html):
            seen.setdefault(p, ([], []))[0].append(a)
            seen[p][1].append(b)

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)

    got = {r.path: (r.pages, r.importance) for r in styletree.importance(df).collect()}
    assert set(got) == set(seen)
    for p, (a, b) in seen.items():
        assert got[p][0] == 12 and got[p][1] == pytest.approx(0.5 * entropy(a) + 0.5 * entropy(b), abs=1e-12)


def test_copies_keep_their_text(spark):
    one = page("<div class=strip>rules</div><div class=story><p>the same</p></div>")
    marked = page("<article><p>the same</p></article>")
    rows = [(k, "http://copies.example/", one) for k in range(30)] + [(100 + k, "http://marked.example/", marked) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.text for r in styletree.main_text(df).collect()}
    assert got == {"rules\nthe same", "the same"}


def test_copies_are_no_evidence_of_a_template(spark):
    body = lambda k: page(f"<div class=strip>rules</div><h1>Head {k}</h1><div class=story><div>text {k}</div></div>")
    rows = [(k, "http://copied.example/", body(max(0, k - 79))) for k in range(100)]
    got = {r.page_id: r.text for r in styletree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {max(0, k - 79)}\ntext {max(0, k - 79)}" for k in range(100)}


def test_hard_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "no url", "<p>a"), (1, "no url", "<p>a"), (2, "HTTP://U:p@Host.Example:80/x", "<p>b")], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in styletree.main_text(df).collect()), key=repr)
    assert got == sorted([(None, None, ""), (1, "no url", "a"), (1, "no url", "a"), (2, "HTTP://U:p@Host.Example:80/x", "b")], key=repr)
    assert [r[0] for r in df.select(styletree.host(df.url)).collect()] == ["", "", "", "host.example"]
    assert styletree.main_text(df.limit(0)).count() == 0


def test_given_pages_give_their_article(spark, sf):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in styletree.main_text(pages).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in parts if x)


def news(rng, n, marked):
    """Pages of a site whose frame has no names and no article is marked, or as tags and names say it; texts of the frame are drawn from a few."""
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)) for _ in range(8)]
    for k in range(n):
        own = [f"story {k} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(rng.randrange(1, 7))]
        menu, ad, end = (rng.choice(lines) for _ in range(3))
        story = "".join(f"<p>{x}</p>" for x in own)
        if marked:
            html = f"<nav><ul><li>{menu}</li></ul></nav><div class=ad>{ad}</div><article>{story}</article><footer>{end}</footer>"
        else:
            html = f"<div class=x1><ul class=y><li>{menu}</li></ul></div><div class=x2>{ad}</div><div class=x3>{story}</div><div class=x4>{end}</div>"
        yield k, f"http://news.example/{k}", page(html), "\n".join(own)


@pytest.mark.parametrize("marked", [True, False])
def test_the_tree_decides(spark, marked):
    """With the tree, all texts are right; without it, none, also where tags and names tell the frame."""
    import random

    rows = list(news(random.Random(3), 60, marked))
    got = {r.page_id: r.text for r in styletree.main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, _, _, text in rows}
    paths = {p: 1.0 for _, _, html, _ in rows for p, _, _ in styletree.features(html)}
    assert not any(styletree.extract(html, paths) == text for _, _, html, text in rows)


def test_time_is_linear_in_depth():
    import time

    for n in (100_000,):
        began = time.perf_counter()
        assert styletree.extract("<div>" * n + "x" + "</div>" * n) == "x"
        assert len(styletree.extract("".join(f"<div>{k}" for k in range(n))).split("\n")) == n
        assert styletree.extract("<b>" * n + "x" + "</i></b>" * n) == "x"
        assert time.perf_counter() - began < 20
