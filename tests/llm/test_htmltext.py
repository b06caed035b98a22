import os
import random

import pytest

from imagora.llm import htmltext

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p><p>no';</script></head><body>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad box\">Buy</div>"
        "<article><header><h1>Head &amp; line</h1></header><p>One\n  two &lt;b&gt; <b>three</b>four<br>five<p>six"
        "<div class='comments'><p>A reader</p></div><form><p>Mail</p></form><p>seven&nbsp;eight</p></article>"
        "<aside>Side</aside><footer>&copy; end</footer>")


def test_one_page():
    assert htmltext.main_text(PAGE) == "Head & line\nOne two <b> threefour\nfive\nsix\nseven eight"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<ul><li>x<li>y</ul>z", "x\ny\nz"),
    ("<div>a<div hidden>b</div>c</div>", "a\nc"), ("<table><tr><td>1<td>2</table>", "1\n2"), ("a</div>b", "a\nb"),
    ("<p title='a>b'>c</p>", "c"), ("<main>m</main>n", "m"), ("<p>cut off <a hre", "cut off"),
    ("<div role='navigation'>n</div><p>&#233;&euro;</p>", "é€"), ("<nav>only</nav>", "")])
def test_small_pages(page, want):
    assert htmltext.main_text(page) == want


def site(n, host="h.example"):
    rng = random.Random(2)
    body = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(2, 5) for _ in range(30))
    rows, want = [], []
    for i in range(n):
        a, b = body(), body()
        rows.append((i, f"http://{host}/{i}", f"<div class='top'><p>Welcome to the site</p></div><div class='x'><p>{a}</p>"
                                              f"<p>{b}</p></div><div class='low'>Imprint and terms</div>"))
        want.append(f"{a}\n{b}")
    return rows, want


def test_template_of_a_host_goes_without_any_stated_role(spark):
    rows, want = site(40)
    alone = [(100, "https://other.example/", rows[0][2]), (101, None, rows[1][2])]
    pages = spark.createDataFrame(rows + alone, "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r for r in htmltext.extract_pages(pages).collect()}
    assert [got[i].text for i in range(40)] == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[100].text.startswith("Welcome") and got[101].text.endswith("terms")


def test_importance(spark):
    rows, _ = site(10)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    nodes = htmltext.tree_nodes(pages, "url", "html").collect()
    assert all(0 <= n.presentation <= 1 + 1e-9 and 0 <= n.content <= 1 + 1e-9 and n.pages == 10 for n in nodes)
    assert sum(n.content == 1 for n in nodes) == 2 and sum(n.content < 1e-9 for n in nodes) == 3


def test_edges(spark):
    rows = [(1, None, None, "x", "y"), (1, None, None, "x", "y"), (None, "nohost", "", "x", "y"),
            (2, "http://U@H:80/p?q", "<p>" + "lang " * 40000, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host string")
    got = sorted(map(tuple, htmltext.extract_pages(pages).collect()), key=str)
    assert [(r[0], r[1], r[3]) for r in got] == [(1, None, 0), (1, None, 0), (2, "http://U@H:80/p?q", 199999), (None, "nohost", 0)]
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
def test_driver_pages_keep_their_article(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?(b|i|a|em|strong)\b[^>]*>", "", p)).split())
                 for p in re.split(r"</?(?:h\d|p|br)\b[^>]*>", inner)]
        assert htmltext.main_text(r.html) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("page,want", [
    ('<body class="no-sidebar"><article>A</article>', "A"),
    ('<div class="with-comments"><article>B</article></div>', "B"),
    ('<article><p class="widget-free">C</p></article>', "C"),
    ('<div class="post-header ad-free">D</div>', "D"),
    ('<p>a<svg width="3"/>b</p><p>c</p>', "ab\nc"),
    ("<p>a<svg><svg><text>x</text></svg><text>y</text></svg>b</p>", "a\nb"),
    ('<form action="/"><main><p>M</p></main></form>', "M"),
    ('<div><p>Long article</p></div><div class="comments"><article>short</article></div>', "Long article"),
    ('<div class="comments-area"><p>x</p></div><div class="ad-banner">y</div><p>z</p>', "z"),
    ('<article class="comment">c</article><p>z</p>', "z"),
    ('<div title=" class=ad">kept</div>', "kept"), ('<body hidden><p>kept</p>', "kept"),
    ("<p>a < b</p><p>c <3</p>", "a < b\nc <3"), ("<!-- open <p>x</p>", ""), ("<script>x</scripts></script>t", "t"),
    ('<main><div class="ad">x</div></main><p>outside</p>', "outside")])
def test_stated_roles(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("piece", ['<a "x ', "<b", "<div><p>", "<div><p>t", '<a x=">" ', "<a x='>\" ", "<!-", "<blockquote>",
                                   "<li><ul>", "<p><table><tr>", "</div>", "<svg>", "&amp", "<script", "<div class='"])
def test_a_megabyte_of_broken_markup(piece):
    import time

    start = time.perf_counter()
    tree = htmltext.parse(piece * ((1 << 20) // len(piece)) + "<p>end</p>")
    # seconds for the time of a slow machine; a quadratic reader takes minutes
    assert time.perf_counter() - start < 10
    assert max(e.depth for e in tree.elements) <= htmltext.OPEN_DEPTH


def test_text_below_the_deepest_element_stays():
    n = 3 * htmltext.OPEN_DEPTH
    page = "".join(f"<div>{i} " for i in range(n)) + "</div>" * n + "<p>after</p>"
    assert htmltext.main_text(page).split() == [str(i) for i in range(n)] + ["after"]


def test_repeated_blocks_inside_main_go(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(12))
    rows, want = [], []
    for i in range(30):
        a, b = text(), text()
        rows.append((i, f"http://m.example/{i}", f"<div><main><section><p>Offer of the week</p></section><h1>{a}</h1><p>{b}</p>"
                                                 f"<ul><li>Save</li><li>Print</li></ul></main></div>"))
        want.append(f"{a}\n{b}")
    # a host that repeats one page: nothing tells its article from a template, so all of it stays
    rows += [(100 + i, "http://mirror.example/x", rows[0][2]) for i in range(8)]
    rows += [(200 + i, "http://plain.example/x", "<div><p>Same on every page</p></div>") for i in range(8)]
    got = {r.page_id: r.text for r in htmltext.extract_pages(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(30)] == want
    assert all(got[100 + i] == f"Offer of the week\n{want[0]}\nSave\nPrint" for i in range(8))
    assert all(got[200 + i] == "Same on every page" for i in range(8))


def test_style_tree_against_brute_force(spark):
    """Importance from its definition, over the page set of each node."""
    import math
    from collections import defaultdict

    rng = random.Random(9)
    rows = []
    for i in range(60):
        parts = [f"<div class='{rng.choice('ab')}'>" + "".join(
            f"<{t}>{rng.choice(['x', 'y', 'z', str(i)])}</{t}>" for t in rng.choices(["p", "h2", "pre"], k=rng.randint(0, 3)))
            + "</div>" for _ in range(rng.randint(0, 3))]
        rows.append((i, f"http://h{i % 3}.example/", "<body>" + "".join(parts)))
    styles, texts, of_host = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, url, page in rows:
        tree = htmltext.parse(page)
        of_host[url].add(i)
        for e in tree.elements[1:]:
            styles[url, e.path].add((i, tuple(e.children)))
        for text, at in tree.blocks:
            while at:
                texts[url, tree.elements[at].path].add((i, text))
                at = tree.elements[at].above
    got = {(f"http://{n.host}/", n.path): n for n in htmltext.tree_nodes(
        spark.createDataFrame(rows, "page_id bigint, url string, html string"), "url", "html").collect()}
    assert set(got) == set(styles)
    for node, seen in styles.items():
        m = len(seen)  # (page, style) pairs: pages, where a page shows one style
        shares = [sum(1 for _, s in seen if s == style) for style in {s for _, s in seen}]
        alike = [sum(1 for _, t in texts[node] if t == text) for text in {t for _, t in texts[node]}]
        style = -sum(k / m * math.log(k / m, m) for k in shares) if m > 1 else 1.0
        content = 0.0 if not alike else sum(max(1 - math.log(k, m), 0) for k in alike) / len(alike) if m > 1 else 1.0
        assert got[node].pages == m and got[node].share == pytest.approx(m / len(of_host[node[0]]))
        assert got[node].presentation == pytest.approx(style, abs=1e-9)
        assert got[node].content == pytest.approx(content, abs=1e-9)
