import random
import time

import pytest

from recfeat.llm import html_extract as h

from ..conftest import rows

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A, b, c</a></li></ul></nav><!-- ad --><div class="ad-box">Buy, buy</div>
<div id="cookie-notice"><p>We use cookies, a lot, really.</p></div>
<article><header><h1>Title &amp; more</h1><span>share</span></header><p>One,
 two <b>three</b><br>four.</p><p>Unclosed<p>Short.</p><ul><li>x<li>y</ul><form><p>Name</p></form><aside><p>Side, note</p></aside>
<table><tr><td>1<td>2</table><div class="comments"><p>Reader, writes, much, much more than the article itself.</p></div></article>
<div class="sidebar"><p>Other, things</p></div><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert h.extract(PAGE) == ["Title & more", "One, two three four.", "Unclosed", "Short.", "x", "y", "1 2"]


def test_siblings_that_read_like_text_are_kept():
    body = "".join(f"<p>Sentence, number {i}, with some words in it, and more of them to count.</p>" for i in range(4))
    page = f"<body><div id=a>{body}</div><div id=b>{body}</div><div><a href=x>link</a> <a href=y>link</a></div></body>"
    assert len(h.extract(page)) == 8


def test_defined_results_for_odd_pages():
    assert h.extract(None) == h.extract("") == h.extract("<p>") == h.extract("<script>x") == []
    assert h.extract("plain text") == ["plain text"]
    assert h.extract("<div hidden><p>a</p></div><div aria-hidden=true><p>b</p></div><p>c") == ["c"]
    assert h.extract("<p>a &lt;b&gt; &#233;&nbsp;x</p>") == ["a <b> é x"]
    assert h.extract("<b>" * 20000 + "deep") == ["deep"]
    assert h.extract("<p>" + "word, " * 200_000) == [" ".join(["word,"] * 200_000)]


def test_wrappers_around_the_article_are_no_menus_and_comments_no_articles():
    page = """<body><form id=aspnet><div class="layout with sidebar"><div class="sidebar"><p>Not, this, one, at, all</p></div>
    <article class="post"><div class="entry-header"><h1>Head</h1></div><p>Text, of it.</p>
    <section class="comments"><article class="comment"><p>Long, long, long reader remark, longer than all.</p></article></section></article></div></form></body>"""
    assert h.extract(page) == ["Head", "Text, of it."]


def test_every_row_gives_a_row(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert rows(h.main_text(df)) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert h.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<a " * 100_000, '<a "' * 100_000, '<a x="' * 100_000, '<a x="' * 100_000 + ">", "<b>" * 100_000 + "x" + "</i>" * 100_000, "<b>x<p>y</p>" * 100_000,
    "<span>" * 100_000 + "<ul>" * 100_000, "<span>" * 50_000 + "<p>word</p>" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "<div><td>" * 100_000, "= " * 200_000 + "<p =" * 50_000 + ">",
], ids=range(12))
def test_time_is_linear_in_the_page(page):
    began = time.time()
    h.extract(page)
    assert time.time() - began < 10


def test_what_is_no_tag_is_text():
    assert h.extract("<p>a<b c</p>") == ["a<b c"]
    assert h.extract("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"]
    assert h.extract('<p title="x > y">kept</p><p>it\'s <a href=\'/"\'>so</a></p>') == ["kept", "it's so"]
    assert h.extract("<p>a<!-->b--><!-- c > --></p>d<!-- e") == ["ab-->", "d"]


def test_an_article_in_parts_without_article_elements():
    """Headings, lists, tables, quotes and short paragraphs between and beside the text stay; link lists and lone headings go."""
    text = "".join(f"<p>Sentence, number {i}, with some words in it, and more of them to count.</p>" for i in range(4))
    page = f"""<body><div class=x><h2>Part one</h2><div>{text * 4}</div><h2>Part two</h2><ul><li>an item</li></ul><p>Short.</p><div>{text}</div>
    <blockquote>Said so.</blockquote>loose words<table><tr><td>1</td></tr></table><ul><li><a href=a>link</a></li></ul><h3>See too</h3></div></body>"""
    got = h.extract(page)
    assert got[0] == "Part one" and got[17:20] == ["Part two", "an item", "Short."] and got[24:] == ["Said so.", "loose words", "1"]


def test_of_equal_containers_the_first_is_the_article():
    side = '<div class="card"><section>{}</section><nav></nav></div>'
    body = "".join(f"<p>{w}, one, two, three, and some more words to fill the line.</p>" for w in ("Aa", "Bb"))
    assert h.extract(side.format(body.replace("Aa", "Cc")) + side.format(body))[0].startswith("Cc")


def naive(root):
    """Points and link densities by their definitions, every one from the whole tree again."""

    def inside(x):
        return [c for c in x.children if isinstance(c, h.Node) and not c.out]

    def length(x):
        return sum(len(c.strip()) for c in x.children if isinstance(c, str)) + sum(map(length, inside(x)))

    def links(x):
        return length(x) if x.tag == "a" else sum(map(links, inside(x)))

    def every(x):
        return [x, *(y for c in inside(x) for y in every(c))]

    nodes = every(root)
    dense = {x: links(x) / max(1, length(x)) for x in nodes}
    points = {}
    for x in nodes:
        loose = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        size = length(x) if x.tag in h._SCORED else loose if x.tag in h._CONTAINER else 0
        if size:
            given = (1 + sum(c.count(",") for c in x.children if isinstance(c, str)) + min(size / 100, 3)) * (1 - dense[x])
            to = x.parent if x.tag in h._SCORED else x
            while to is not None and to.tag not in h._CONTAINER and to.tag != "#root":
                to = to.parent
            if to is not None:
                points.setdefault(to, []).append(given)
                if to.parent is not None:
                    points.setdefault(to.parent, []).append(given / 2)
    bonus = lambda x: 25 if x.tag in ("article", "main") else 10 if x.attrs and h._GOOD_WORDS.search(x.attrs) else 0
    return {x: sum(p) * (1 - dense[x]) + bonus(x) for x, p in points.items()}, dense


@pytest.mark.parametrize("seed", range(30))
def test_points_equal_a_naive_count(seed):
    rng = random.Random(seed)
    names = ["div", "p", "article", "section", "ul", "li", "a", "b", "td", "table", "h2", "span", "main", "nav", "blockquote"]
    page = "".join(rng.choice([f"<{rng.choice(names)} class={rng.choice(['content', 'x', 'ad'])}>", f"</{rng.choice(names)}>", "some words, and more ", "x" * rng.randint(1, 300)]) for _ in range(150))
    root = h.parse(page)
    score, density = h.scored(h._in_order(root))
    want, dense = naive(root)
    assert density == pytest.approx(dense) and {k: pytest.approx(v) for k, v in want.items()} == score
