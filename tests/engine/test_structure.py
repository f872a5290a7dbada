import random
import re

from lumenreel.sources import sites
from lumenreel.sources import structure as S

CARDS = """<html><body><h5 class=sr-only>before</h5>
<div class="card in-theater"><h3 class="title main"><a href='/film/1'>The &amp; Red <b>Shoes</b></a></h3><h5>one</h5><h5>1948 / 133min / DCP</h5>
 <div class="times"><h6>Friday May 1</h6><div class="day"><a href="/buy?id=1">7:00pm</a> <a href="/buy?id=2">9:30pm</a></div><h6>Saturday May 2</h6><div class="day"><a href="/buy?id=3">noon</a></div></div></div>
<div class="card"><h3 class="title"><a href="/film/2">Ran</a></h3><div class="times"><div class="day"><a>no date</a></div></div><script>var x="<div class='card'>";</script></div>
<div class="card"><h3 class="title"><a href="/film/3">Empty</a></h3></div><!-- <div class="card"> --><div class="day"><a href="/x">outside</a></div></body></html>"""
SITE = S.Site(
    card=".card", rows=".times .day > a", fields={"title": ("h3.title a", "text"), "url": ("h3.title a", "href"), "meta": ("h5", "text", 1)},
    row_fields={"time": "text", "ticket": "href"}, running={"date": ("h6, h5.sr-only", "text")},
)


def test_a_site_as_data(spark):
    rows = S.listing(spark.createDataFrame([(1, CARDS), (2, ""), (3, None)], "page_id long, html string"), SITE).orderBy("start").collect()
    assert [(r.title, r.url, r.meta, r.date, r.time, r.ticket) for r in rows] == [
        ("The & Red Shoes", "/film/1", "1948 / 133min / DCP", "Friday May 1", "7:00pm", "/buy?id=1"),
        ("The & Red Shoes", "/film/1", "1948 / 133min / DCP", "Friday May 1", "9:30pm", "/buy?id=2"),
        ("The & Red Shoes", "/film/1", "1948 / 133min / DCP", "Saturday May 2", "noon", "/buy?id=3"),
        ("Ran", "/film/2", None, None, "no date", None),
    ]


SHOWN = {
    "metrograph": """<div class="homepage-in-theater-movie"><a><img class="main-image" src="/p.jpg"></a><h3 class="movie_title"><a href="/film?id=9">Heat</a></h3><h5>Michael Mann</h5><h5>1995 / 170min / 35mm</h5>
        <div class="showtimes"><h6>Fri May 1</h6><div class="film_day"><a href="/t/1">7:00pm</a></div></div></div>""",
    "quad": """<div class="now-single-day"><div class="trailing-rule-wrap"><h1>Fri 1 May</h1></div><div class="now-listings"><div class="single-listing"><h4><a href="/film/ran">Ran</a></h4><ul class="showtimes-list"><li><a href="https://t.example/5">1.30pm</a><li><a href="/6">4.00pm*</a></ul></div>
        <div class="single-listing"><h4><a href="/event/x">Party</a></h4><ul class="showtimes-list"><li><a href="/7">9.00pm</a></ul></div></div></div>""",
    "roxy": """<div class="detailed-screening__card" data-datetime="2024-05-01T19:00"><div class="detailed-screening__title">Jaws [35mm]</div><div class="detailed-screening__time">7pm</div><div class="detailed-screening__info">1975, 124 min</div>
        <a class="detailed-screening__cta" href="https://x/purchase/77/">Buy</a><a class="detailed-screening__cta cta--text-link" href="/jaws">More</a></div>
        <div class="detailed-screening__card"><div class="detailed-screening__title">Alien</div><div class="detailed-screening__time">May 2, 9pm</div></div>""",
}


def test_sites(spark):
    pages = spark.createDataFrame([(i, slug, f"https://{slug}.example/now/", html) for i, (slug, html) in enumerate(SHOWN.items())], "page_id long, slug string, url string, html string")
    got = sorted(map(tuple, sites.scraped_pages(pages).select("slug", "movie_title", "start_raw", "ticket_url", "source_url", "raw_format", "year", "runtime", "poster_url").collect()))
    assert got == [
        ("metrograph", "Heat", "Fri May 1 7:00pm", "https://metrograph.example/t/1", "https://metrograph.example/film?id=9", "35mm", 1995, 170, "https://metrograph.example/p.jpg"),
        ("quad", "Ran", "Fri 1 May 1.30pm", "https://t.example/5", "https://quad.example/film/ran", None, None, None, None),
        ("quad", "Ran", "Fri 1 May 4.00pm", "https://quad.example/6", "https://quad.example/film/ran", None, None, None, None),
        ("roxy", "Alien", "May 2, 9pm", None, "https://roxy.example/now/", None, None, None, None),
        ("roxy", "Jaws [35mm]", "2024-05-01T19:00", "https://x/purchase/77/", "https://roxy.example/jaws", None, 1975, 124, None),
    ]
    assert sites.scraped_pages(pages.filter("slug = 'none'")).collect() == []


def found(spark, html, selector):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    t = S.tokens(pages)
    rows = S.with_text(S.select(S.elements(t), selector), S.texts(t)).orderBy("start").collect()
    return [r.text for r in rows]


def test_ends_that_are_left_out(spark):
    html = "<ul><li>a<ul><li>a1<li>a2</ul><li>b</ul><article><p><b>x<br><p>y <i>z</i></p>w<p>last</article><p>tail<div>d</div><table><tr><td>1<td>2<tr><th>3</table><dl><dt>t<dd>u</dl>"
    assert found(spark, html, "li") == ["a a1 a2", "a1", "a2", "b"]
    assert found(spark, html, "ul > li > ul > li") == ["a1", "a2"]
    assert found(spark, html, "p") == ["x", "y z", "last", "tail"]
    assert found(spark, html, "article p") == ["x", "y z", "last"]
    assert found(spark, html, "p b") == ["x"]
    assert found(spark, html, "td, th") == ["1", "2", "3"]
    assert found(spark, html, "tr") == ["1 2", "3"]
    assert found(spark, html, "dl > dd") == ["u"]
    assert found(spark, "</div></p><div>a</b></div><br/><img src=x><span>open", "div, span") == ["a", "open"]


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.kids, self.text = tag, attrs, up, [], []


def made(rng, depth=0):
    """A balanced tree of elements without implied ends, as markup and as (tag, classes, path) in order."""
    out = []
    for _ in range(rng.randint(1, 3)):
        tag, cls = rng.choice(["div", "span", "section", "b"]), rng.choice([None, "x", "y", "x y"])
        out.append((tag, cls, made(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else rng.choice(["", "t", "u & v"])))
    return out


def markup(tree):
    if isinstance(tree, str):
        return tree.replace("&", "&amp;")
    return "".join(f"<{t}{f' class={chr(34)}{c}{chr(34)}' if c else ''}>{markup(k)}</{t}>" for t, c, k in tree)


def matches(tree, selector, path=()):
    """Texts of elements whose path fits, in order."""
    steps = re.findall(r">|[^\s>]+", selector)

    def fit(node, s):
        tag, _, cls = s.partition(".")
        return (not tag or node[0] == tag) and (not cls or cls in (node[1] or "").split())

    def ends(nodes, steps):
        if not fit(nodes[-1], steps[-1]):
            return False
        if len(steps) == 1:
            return True
        if steps[-2] == ">":
            return len(nodes) > 1 and ends(nodes[:-1], steps[:-2])
        return any(ends(nodes[:i], steps[:-1]) for i in range(1, len(nodes)))

    def text(t):
        return t if isinstance(t, str) else "".join(f" {text(k)} " if n in S.BLOCK else text(k) for n, _, k in t)

    out = []
    for node in [] if isinstance(tree, str) else tree:
        here = (*path, node)
        if ends(here, steps):
            out.append(" ".join(text(node[2]).split()))
        out += matches(node[2], selector, here)
    return out


def test_selectors_against_a_walk(spark):
    rng = random.Random(3)
    trees = [made(rng) for _ in range(25)]
    pages = spark.createDataFrame([(i, markup(t)) for i, t in enumerate(trees)], "page_id long, html string")
    t = S.tokens(pages).cache()
    rows, whole = S.elements(t).cache(), S.texts(t)
    for selector in ("div", ".x", "div span", "div > span", "section .y b", ".x > .y", "div > div span.x"):
        got = S.with_text(S.select(rows, selector), whole).orderBy("page_id", "start").collect()
        assert [(r.page_id, r.text) for r in got] == [(i, x) for i, tree in enumerate(trees) for x in matches(tree, selector)], selector
