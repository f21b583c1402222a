"""Forms of pages beyond the usual: names inside articles, short sections, very large and broken pages; sums and names against plain walks."""

from __future__ import annotations

import random
import re
import time

import pytest

from reportloom.llm import html as H

LONG = "A paragraph of the text, long enough to be scored, with commas, and with words that go on for a while."
ARTICLE = f"<body><article><h1>Head</h1><p>{LONG}</p>{{}}<p>{LONG} End.</p><p>{LONG} More.</p></article></body>"
KEPT = ["Head", LONG, f"{LONG} End.", f"{LONG} More."]


@pytest.mark.parametrize(
    "part",
    [
        f"<section class='user-comments'><p>{LONG} Reader.</p></section>",
        f"<div class='comment-thread'><p>{LONG} Reader.</p></div>",
        f"<div id='responses'><article><p>{LONG} Reader.</p></article></div>",
        "<div class='google-ad-slot'><p>Buy this thing, it is the best of all things.</p></div>",
        "<div class='promo-offer'><p>Ten per cent off, for readers of this page only.</p></div>",
    ],
)
def test_comments_and_adverts_in_an_article_go(part):
    assert H.main_blocks(ARTICLE.format(part)) == KEPT


def test_other_names_in_an_article_stay():
    for name in ("share-price-table", "related-work", "social-history", "navigation-of-ships", "ad-price-table", "comment-war-chart"):
        assert H.main_blocks(ARTICLE.format(f"<div class='{name}'><p>{LONG} Inner.</p></div>")) == [*KEPT[:2], f"{LONG} Inner.", *KEPT[2:]]


def test_a_name_over_most_of_an_article_says_nothing():
    page = f"<body><article><h1>Head</h1><div class='story-promo-body'><p>{LONG}</p><p>{LONG} End.</p></div></article></body>"
    assert H.main_blocks(page) == ["Head", LONG, f"{LONG} End."]


def test_short_sections_and_second_articles_stay():
    long = f"<p>{LONG}</p><p>{LONG}</p>"
    page = f"<body><section><h2>One</h2>{long}</section><section><h2>Two</h2><p>Short, para.</p></section><section><h2>Three</h2>{long}</section></body>"
    assert H.main_blocks(page) == ["One", LONG, LONG, "Two", "Short, para.", "Three", LONG, LONG]
    links = "<ul><li><a href='x'>First link of many</a></li><li><a href='y'>Second link of many</a></li></ul>"
    page = f"<body><section><h2>One</h2>{long}</section><div>{links}</div><section><h2>Three</h2>{long}</section></body>"
    assert H.main_blocks(page) == ["One", LONG, LONG, "Three", LONG, LONG]
    page = f"<body><article><h1>A</h1>{long}</article><article><h2>B</h2><p>Short one.</p></article></body>"
    assert H.main_blocks(page) == ["A", LONG, LONG, "B", "Short one."]


def test_long_numbers_in_references():
    assert H.main_blocks(f"<p>{LONG} &#{'1' * 6000}; &#{'0' * 6000}65; &#x41; &amp;</p>") == [f"{LONG} � A A &"]


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + LONG,
        "<a " * 400_000,
        f"<div><p>{LONG}" * 20_000,
        "<a \"" * 300_000,
        "<a '\"" * 250_000,
        "<aaaa" * 250_000,
        "<a \"" + "<a " * 300_000 + '" "',
        "<ul><li><ul>" + "<div>" * 80_000 + "<li>x</li>" * 80_000,
        "<div>" * 100_000 + "</section>" * 50_000,
        f"<div class=comments><article>{LONG}" * 15_000,
        "<header><h2>x" * 80_000,
        "<!--" * 300_000,
        "<table><tr><td>" * 60_000,
        "<a href=" + "x" * 1_200_000 + f"></a><p>{LONG}</p>",
    ],
    ids=range(14),
)
def test_a_megabyte_of_any_form_takes_seconds(page):
    began = time.monotonic()
    H.main_blocks(page)
    assert time.monotonic() - began < 20


# A plain walk over the page with one pattern, and plain walks up the elements, to hold the linear forms against.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_BITS = ["<div>", "</div>", "<p>", "</p>", "<a href='x'>", "</a>", "<a ", '"', "'", ">", LONG, "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<h1>x", "</h1>", "<section class='comments'>"]
_BITS += ["</section>", "<article>", "</article>", "<div class='user-comments'>", "<div id='responses'>", "<header>", "<main>", "</main>", "<!-- x -->", "<!", "&amp;", "<br>", "<div class='sidebar'>", "<div class='ad-x'>"]


def _pages(n: int):
    r = random.Random(11)
    return ["".join(r.choice(_BITS) + " " for _ in range(r.randrange(1, 50))) for _ in range(n)]


def test_ends_of_tags_are_those_of_one_pattern():
    for page in _pages(3000):
        tags, at = H._Tags(page), 0
        while at < len(page):
            m = _PLAIN.match(page, at)
            if page[at] == "<" and (name := H._NAME.match(page, at)):
                assert (tags.end(name.end()) + 1 or None) == (m.end() if m[2] else None), page
            at = m.end()


def _up(x):
    while x is not None:
        yield x
        x = x.up


def test_names_dropped_are_those_of_plain_walks(monkeypatch):
    linear, seen = H._drop_named, []

    def plain(nodes, blocks):
        before = [x.named for x in nodes]
        linear(nodes, blocks)
        got = [x.named for x in nodes]
        under = {id(x): 0.0 for x in nodes}
        h1, articles = set(), {}
        for node, text, _ in blocks:
            for x in _up(node):
                under[id(x)] += H._points(node.tag, text)
                h1 |= {id(x)} if node.tag == "h1" else set()
                if x.tag in ("article", "main"):
                    articles[id(x)] = x
        named = {id(x) for x, b in zip(nodes, before, strict=True) if b}
        total = under[id(nodes[0])]
        for x in nodes:
            outer = [y for y in _up(x) if y.tag in ("article", "main")]
            if x.braked and outer and under[id(x)] > H._BRAKE * under[id(outer[-1])]:
                named.discard(id(x))
        free = lambda x: not any(id(y) in named for y in _up(x))
        order = sorted((x for x in nodes if id(x) in named), key=lambda x: -round(under[id(x)], 9))
        if not any(id(a) in h1 and free(a) for a in articles.values()):
            named -= {id(x) for x in order if under[id(x)] > 0.5 * total and id(x) in h1}
        holds = {id(y) for a in articles.values() for y in _up(a.up)}
        for x in order:
            if id(x) in holds and not any(free(a) for a in articles.values()):
                named.discard(id(x))
        for x in order:
            if under[id(x)] > 0.5 * total and not any(free(b[0]) for b in blocks):
                named.discard(id(x))
        seen.append(got == [id(x) in named for x in nodes])

    monkeypatch.setattr(H, "_drop_named", plain)
    for page in _pages(4000):
        H._blocks(page)
    assert len(seen) > 500 and all(seen)


def test_sums_of_elements_are_those_of_their_blocks(monkeypatch):
    kept = []
    inner = H._blocks
    monkeypatch.setattr(H, "_blocks", lambda page: kept.append(inner(page)) or kept[-1])
    for page in _pages(1500):
        H.main_blocks(page)
        blocks, nodes = kept[-1]
        for x in nodes if blocks else ():
            assert x.chars == sum(len(t) for n, t, _ in blocks if any(y is x for y in _up(n)))
