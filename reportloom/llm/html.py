"""Main text of web pages by tree scoring.

Each text run of a block element is a paragraph. It passes points for its length and commas to its container and, halved and
then by thirds, to the ancestors above; a container's points are discounted by its link density. If the best container is in an
article or main, all of that is the text, but for lists of links beside the article, and so are other articles beside it. Else the best
container is kept, with h1 and sections beside it, those siblings that score a fifth of it or are long paragraphs with few links, and
what stands between these, but for lists of links. What a page says is furniture - by element, role or class - takes no part; but a class
or id that only describes the layout says nothing, one on the container of the text doesn't count, and in an article or main only names
do that are wholly made of furniture's words or, unless most of the article stands under them, tell comments or adverts by their head.
Blocks come out in page order, each on one line. The work is linear in a page's size, whatever its nesting and its unclosed tags.

Defined results: a null or empty page gives the empty text; unclosed, misnested and cut-off markup is closed where a browser
would close it, as far as it shapes the text; a page without any paragraph that scores gives what text its body has outside
furniture; equal pages give equal texts, also in repeated rows; null ids and urls stay null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import map_arrow

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,63}+)")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)")
_DELIMITER = re.compile("[>\"']")
_ZEROS, _LONG_NUMBER = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
_BLOCK = {
    "html", "body", "head", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "select", "option", "button", "legend", "label",
}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "fieldset"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|notices?|cookies?|consent|banner|popup|modal|overlay|menu\w*|nav\w*|breadcrumbs?|footer|sidebar|widget|"
    r"comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|pagination|pager|masthead|toolbar|header|skip)(?:$|[\s_-])",
    re.I,
)
#: Parts of names that say nothing. In an article or main, a name is furniture only if it is made of these and of furniture's own words:
#: share-buttons is, share-price-table isn't.
_NEUTRAL = re.compile(
    r"(?:box|wrap|wrapper|container|block|blocks|list|lists|section|area|slot|unit|bar|buttons?|links?|title|content|inner|outer|left|right|top|bottom|primary|secondary|main|site|page|post|posts|"
    r"entry|article|articles|global|item|items|group|row|col|form|tools?|icons?|[0-9]+|mobile|desktop|inline)",
    re.I,
)
#: Compounds that describe a layout or state and no furniture (has-sidebar, comments-open), and headers of a text.
_LAYOUT = re.compile(r"(?:^|[_-])(?:has|with|no|without)[_-]|[_-](?:open|closed|enabled|disabled)$|(?:^|[_-])(?:post|entry|article|story)[_-]+header$", re.I)
#: Parts of names that tell comments and adverts where a name's head is one, whatever stands before it: user-comments, google-ad-slot, but
#: not ad-price-table. The head is the last part that isn't neutral and doesn't tell a piece of such (comment-thread, promo-offer).
_DECISIVE = re.compile(r"comments?|commentlist|disqus|ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promos?|promoted|promotions?", re.I)
_PIECE = re.compile(r"threads?|feed|body|author|meta|replies|offers?|placement|spot|space|break", re.I)
#: Whole names of comments' containers.
_RESPONSES = re.compile(r"(?:(?:reader|user)s?[_-]+)?(?:responses?|replies)(?:[_-]+(?:list|section|thread|area|wrap|wrapper|container))?", re.I)
#: A head says nothing on an element that holds more than this share of its article's points.
_BRAKE = 0.75
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_CELLS = {"td", "th", "button", "table"}
# What an opening tag may close: the nearest open element of these is closed if it is among the first, and a border if among the second.
_P_GROUP, _H_GROUP = ({"p"}, _CELLS), ({"p"} | _HEADINGS, _CELLS)
_GROUPS = [*{str(sorted(g[0])): g for g in _CLOSES.values()}.values(), _P_GROUP, _H_GROUP]
_GROUP_OF = {t: next((k for k, g in enumerate(_GROUPS) if g == _CLOSES.get(t)), len(_GROUPS) - 1 if t in _HEADINGS else len(_GROUPS) - 2) for t in _BLOCK}
_MEMBER_OF = {t: [k for k, g in enumerate(_GROUPS) if t in g[0] or t in g[1]] for t in _BLOCK}


class _Node:
    """An open or closed block element. What its ancestors say - dropped, inside an article, furniture - is put down when it is made."""

    __slots__ = ("tag", "up", "score", "chars", "link_chars", "drop", "head", "own", "named", "title", "points", "h1", "inside", "furniture", "braked", "depth", "rank")

    def __init__(self, tag: str, up: _Node | None, head: bool, own: bool = False, named: bool = False, title: bool = False, braked: bool = False):
        self.tag, self.up, self.head, self.own, self.named, self.title, self.braked = tag, up, head, own, named, title, braked
        self.score, self.chars, self.link_chars, self.points, self.h1, self.rank = 0.0, 0, 0, 0.0, False, -1
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.judge(own)

    def judge(self, own: bool) -> None:
        """Whether it is dropped, and whether anything but a header drops it. The parent must have been judged before."""
        up = self.up
        above = up is not None and up.drop
        self.drop = own or above and not (self.title and not up.furniture)
        self.furniture = self.drop and (above if self.tag == "header" else not above or up.furniture)


def _names_furniture(name: str, inside: bool) -> tuple[bool, bool]:
    """Whether one class or id names furniture, and whether by its head alone; inside an article or main, else every part of it must."""
    if _RESPONSES.fullmatch(name):
        return True, False
    if not _NAMES.search(name) or _LAYOUT.search(name):
        return False, False
    if not inside:
        return True, False
    parts = [x for x in re.split("[_-]+", name) if x]
    if all(_NAMES.fullmatch(x) or _NEUTRAL.fullmatch(x) for x in parts):
        return True, False
    head = next((x for x in reversed(parts) if _DECISIVE.fullmatch(x) or not (_NEUTRAL.fullmatch(x) or _PIECE.fullmatch(x))), "")
    decisive = _DECISIVE.fullmatch(head) is not None
    return decisive, decisive


def _furniture(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is furniture, whether a class or id says so, and whether by heads of names alone; inside: it stands in an article or main."""
    if tag in _FURNITURE or tag == "header":
        return True, False, False
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, False, False
    said = []
    for k, a, b, c in _ATTR.findall(attrs):
        v, k = a or b or c, k.lower()
        if k == "hidden" or k == "role" and v.lower() in _ROLES:
            return True, False, False
        if k in ("class", "id"):
            said += [braked for named, braked in (_names_furniture(x, inside) for x in v.split()) if named]
    return False, bool(said), bool(said) and all(said)


def _points(tag: str, text: str) -> float:
    return 0.0 if tag in _HEADINGS or len(text) < 25 else 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)


def _unname(named: list[_Node], nodes: list[_Node], holders: list[_Node]) -> None:
    """Takes names off, in the order given, until one of the holders is under no name any more.

    An element's rank is the last place in that order among the names over it, so the least rank of the holders is the place to stop at.
    """
    order = {id(x): k for k, x in enumerate(named)}
    for x in nodes:
        own = order.get(id(x), len(named)) if x.named else -1
        x.rank = max(own, x.up.rank if x.up is not None else -1)
    for x in named[: min((h.rank for h in holders), default=-1) + 1]:
        x.named = False


def _drop_named(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Drops what classes and ids name furniture, but for containers of the text. nodes: all, parents before children.

    These are elements named by heads of names alone that hold most of their article's points; elements that hold more than half of the
    page's points and an h1; while no article or main is left, those that hold one, by points; and, if no block is left, the one with more
    than half of the points.
    """
    holding = set()
    for node, text, _ in blocks:
        node.points += _points(node.tag, text)
        node.h1 = node.h1 or node.tag == "h1"
        holding.add(id(node))
    articles, holds = [], set()
    for x in reversed(nodes):
        if x.up is not None:
            x.up.points += x.points
            x.up.h1 = x.up.h1 or x.h1
            if id(x) in holding:
                holding.add(id(x.up))
            if id(x) in holds or x.tag in ("article", "main") and id(x) in holding:
                holds.add(id(x.up))
        if x.tag in ("article", "main") and id(x) in holding:
            articles.append(x)
    total = nodes[0].points
    around: dict[int, _Node | None] = {}  # the outermost article or main
    for x in nodes:
        above = around.get(id(x.up)) if x.up is not None else None
        around[id(x)] = above or (x if x.tag in ("article", "main") else None)
        if x.named and x.braked and around[id(x)] is not None and x.points > _BRAKE * around[id(x)].points:
            x.named = False
    named = sorted((x for x in nodes if x.named), key=lambda x: -x.points)
    for x in nodes:
        x.rank = 0 if x.named or x.up is not None and x.up.rank == 0 else -1
    if not any(a.h1 for a in articles if a.rank < 0):
        for x in named:
            if x.points > 0.5 * total and x.h1:
                x.named = False
    if articles:
        _unname([x for x in named if x.named and id(x) in holds], nodes, articles)
    else:
        for x in (x for x in named if id(x) in holds):
            x.named = False
    _unname([x for x in named if x.named and x.points > 0.5 * total], nodes, [b[0] for b in blocks])
    for x in nodes:
        x.judge(x.own or x.named)


class _Tags:
    """Finds the end of a tag: the next > outside quotes. A quote from which none is found is remembered, so that a page is looked over once."""

    def __init__(self, page: str):
        self.page, self.failed, self.next, self.start = page, set(), -1, 0

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`, or -1."""
        if not self.start <= at <= self.next:
            m = _ATTRS.match(self.page, at, at + 256)
            if m:
                return m.end()
        seen = []
        while True:
            if not self.start <= at <= self.next:
                d = _DELIMITER.search(self.page, at)
                self.start, self.next = at, d.start() if d else len(self.page)
            d = self.next
            if d < len(self.page) and self.page[d] == ">":
                return d
            shut = -1 if d == len(self.page) or d in self.failed else self.page.find(self.page[d], d + 1)
            seen.append(d)
            if shut < 0:
                self.failed.update(seen)
                return -1
            at = shut + 1


def _unescape(text: str) -> str:
    """Character references decoded; decimal ones too long for a number are U+FFFD, as those out of range."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


def _blocks(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """(element, text, characters inside links) of each text run outside furniture, in page order, and all elements, parents first."""
    top = _Node("#page", None, False)
    node, out, run, nodes = top, [], [], [top]
    linked, in_link = 0, False
    at, n, tags = 0, len(page), _Tags(page)
    opened: dict[str, list[_Node]] = {t: [] for t in _BLOCK}
    groups: list[list[_Node]] = [[] for _ in _GROUPS]

    def flush() -> None:
        nonlocal linked
        if run:
            if not node.drop and (text := " ".join(_unescape("".join(run)).split())):
                out.append((node, text, min(linked, len(text))))
            run.clear()
        linked = 0

    def close(until: _Node) -> None:
        nonlocal node, in_link
        flush()
        in_link = False
        while node is not until:
            opened[node.tag].pop()
            for k in _MEMBER_OF[node.tag]:
                groups[k].pop()
            node = node.up

    def say(text: str) -> None:
        nonlocal linked
        run.append(text)
        if in_link:
            linked += len(text)

    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            say(page[at:end])
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, at)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at += 1
            continue
        name, ending, attrs = m[2].lower(), m[1], page[m.end() : end]
        at = end + 1
        if name == "a":
            in_link = not ending
        elif name == "br":
            run.append(" ")
        elif name == "hr":
            flush()
        elif name in _RAW:
            if not ending and not attrs.endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = shut.end() if shut else n
        elif name in _BLOCK:
            if ending:
                if opened[name]:
                    close(opened[name][-1].up)
                else:
                    flush()
            else:
                flush()
                k = _GROUP_OF[name]
                if groups[k] and groups[k][-1].tag in _GROUPS[k][0]:
                    close(groups[k][-1].up)
                title = name in _HEADINGS and node.head and node.inside  # a heading in the article's own header
                own, named, braked = _furniture(name, attrs, node.inside)
                node = _Node(name, node, node.head or name == "header", own, named, title, braked)
                nodes.append(node)
                opened[name].append(node)
                for k in _MEMBER_OF[name]:
                    groups[k].append(node)
    flush()
    if any(x.named for x in nodes):
        _drop_named(nodes, out)
        out = [b for b in out if not b[0].drop]
    return out, nodes


def _outermost(x: _Node | None, tag: str) -> _Node | None:
    found = None
    while x is not None:
        if x.tag == tag:
            found = x
        x = x.up
    return found


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text of a page."""
    blocks, nodes = _blocks(page)
    if not blocks:
        return []
    scored: dict[int, _Node] = {}
    for node, text, linked in blocks:
        node.chars += len(text)
        node.link_chars += linked
        holder = node if node.tag in ("div", "section", "article", "main", "body", "#page", "td") else node.up or node
        points = _points(node.tag, text)
        part, level = points, 0
        while points and holder is not None and holder.tag not in ("html", "#page") and level < 6:
            if id(holder) not in scored:
                scored[id(holder)] = holder
                holder.score += {"article": 25, "main": 15}.get(holder.tag, 5 if holder.tag in ("div", "section", "td", "blockquote") else 0)
            holder.score += part
            level += 1
            part = points / 2 if level == 1 else points / (3 * level)
            holder = holder.up
    for x in reversed(nodes):
        if x.up is not None:
            x.up.chars += x.chars
            x.up.link_chars += x.link_chars
    if not scored:
        named = [b for b in blocks if b[0].inside]
        return [t for node, t, linked in named or blocks if named or linked < 0.5 * len(t)]
    value = {k: x.score * (1 - x.link_chars / max(1, x.chars)) for k, x in scored.items()}
    best = scored[max(value, key=value.__getitem__)]
    # a list, table cell or heading group isn't a container of its own
    while best.tag in ("p", "li", "ul", "ol", "tr", "td", "tbody", "table", "blockquote", "dl", "dd") and best.up is not None and best.up.tag not in ("body", "html", "#page"):
        best = best.up
    # the parts of an article are one text, whichever of them scores most
    best = _outermost(best, "article") or best
    main = _outermost(best, "main")
    best = best if best.tag == "article" else main or best
    least = max(10.0, 0.2 * value.get(id(best), best.score))

    around = set()  # from the article up to its main
    x = best.up
    while main is not None and best is not main and x is not None and x is not main.up:
        around.add(id(x))
        x = x.up
    kept: dict[int, bool] = {id(best): True} | dict.fromkeys(around, True)

    def keep(x: _Node, text: str) -> bool:
        chain = []
        while x is not None:
            if id(x) in kept:
                got = kept[id(x)]
                # beside the article in its main: all but lists of links
                if chain and id(x) in around:
                    y = chain[-1]
                    got = y.tag in _HEADINGS or y.link_chars < 0.5 * y.chars
                break
            chain.append(x)
            if x.up is best.up and best.up is not None:
                few = x.link_chars / max(1, x.chars) < 0.25
                if best.tag in ("article", "main") and best.up.tag in ("body", "html", "#page"):
                    got = x.tag == best.tag and x.link_chars < 0.5 * x.chars
                else:
                    got = value.get(id(x), 0) >= least or x.tag == "p" and few and x.chars > 80 or x.tag == "h1" or few and x.tag == best.tag == "section"
                break
            x = x.up
        else:
            got = False
        for y in chain:
            kept[id(y)] = got
        return got

    got = [keep(node, t) for node, t, _ in blocks]
    if best.tag not in ("article", "main"):
        # what stands between parts of the text is text, unless it is a list of links
        first, last = got.index(True), len(got) - got[::-1].index(True)
        got[first:last] = [g or node.link_chars < 0.5 * node.chars for g, (node, _, _) in zip(got[first:last], blocks[first:last], strict=True)]
    return [t for (_, t, _), g in zip(blocks, got, strict=True) if g]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html). No exchange."""

    def f(b: pa.RecordBatch) -> dict:
        texts = ["\n".join(main_blocks(x)) if x else "" for x in b.column(2).to_pylist()]
        return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), "page_id long, url string, text string, n_chars long", f)
