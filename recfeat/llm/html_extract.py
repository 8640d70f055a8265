"""Main text of web pages by tree scoring.

The page becomes a tree of elements. Every paragraph passes points for its length and commas to its
parent, and half of them to the grandparent; an element's points are discounted by its link density.
The best container is kept, with those siblings that score well or read like running text. What is
surely not article (menus, forms, scripts, notices, reader comments) is left out before and inside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)((?:[^<>=]+|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map nav aside footer form button select "
    "input textarea option label fieldset menu dialog title noembed noframes xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCORED = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6".split())
_CONTAINER = frozenset("article section div main body td blockquote html".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
_BAD_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banners?|comments?|comment-?\w*|disqus|respond|replies|reply|"
    r"sidebar\w*|side|rail|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|footer\w*|foot|header|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|subscription|share|sharing|social|"
    r"related|recommend\w*|popular|trending|tags|toolbar|skip|login|search|copyright|legal|disclaimer|outbrain|taboola|byline-share)(?:$|[-_\s0-9])",
    re.I,
)
_ASIDE_WORDS = re.compile(r"(?:^|[-_\s])(?:comments?|comment-?\w*|reply|replies|respond|related|teaser|promo\w*|sponsor\w*|widget|ads?)(?:$|[-_\s0-9])", re.I)
_TITLE_WORDS = re.compile(r"(?:^|[-_\s])(?:article|entry|post|story|content)-?header(?:$|[-_\s0-9])", re.I)
_GOOD_WORDS = re.compile(r"(?:^|[-_\s])(?:article\w*|body|content|entry|main|post|story|text|page|column)(?:$|[-_\s0-9])", re.I)
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_SAME = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = frozenset(["p"])
_RUNNING = frozenset("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6 section div".split())
_FENCE = frozenset("article aside body div footer form header main nav section table td th".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "out", "holds")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.out = tag in DROPPED
        self.holds = False  # the page's article, somewhere below


class _Open:
    """The elements that are open, and where those of each name stand; nothing here walks over what stays open."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, height: int) -> None:
        while len(self.stack) > height:
            self.places[self.stack.pop().tag].pop()

    def highest(self, tags) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tag: str) -> None:
        """An end tag; one of an inline element closes nothing beyond the block it stands in."""
        at = self.highest((tag,))
        if at and (tag not in _INLINE or at > self.highest(_FENCE)):
            self.cut(at)

    def close_open(self, tags: frozenset, fence: frozenset) -> None:
        """Close the innermost element of these names, if no element of ``fence`` is open within it."""
        at = self.highest(tags)
        if not at or at < self.highest(fence):
            return
        if len(tags) > 1:  # a new row also ends the row of an open cell
            while at > 1 and self.stack[at - 1].tag in tags:
                at -= 1
        self.cut(at)


def _markup(page: str, at: int, last: int) -> tuple[int, int, re.Match | None]:
    """Where the next tag, comment or declaration stands from ``at`` on: start, end and, of a tag, its match.

    ``last`` is the place of the page's last ``>``. What is no complete tag (``a < b``, a tag that another one
    interrupts or that does not end) is text. A comment without an end takes the rest.
    """
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                return start, page.index(">", start) + 1, None
            end = page.find("-->", start + 4)
            return start, end + 3 if end >= 0 else len(page), None
        if start > last:
            at = page.find("<!--", start)
            if at < 0:
                break
            continue
        if page.startswith(("<!", "<?"), start):
            return start, page.index(">", start) + 1, None
        if m := _TAG.match(page, start):
            return start, m.end(), m
        at = start + 1
    return len(page), len(page), None


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs, items and cells close by themselves, stray end tags are ignored.

    Children are nodes and strings with character references decoded. The time is linear in the page's length.
    """
    root = Node("#root", "", None)
    opened, at, lower = _Open(root), 0, None
    size, last = len(page), page.rfind(">")
    while at < size:
        start, end, m = _markup(page, at, last)
        if text := page[at:start]:
            opened.top().children.append(html.unescape(text) if "&" in text else text)
        at = end
        if m is None:
            continue
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if closing:
            opened.close(tag)
            continue
        if tag in _CLOSES_P:
            opened.close_open(_P, _FENCE)
        if tag in _SAME:
            opened.close_open(*_SAME[tag])
        if tag in HEADINGS and opened.top().tag in HEADINGS:
            opened.cut(len(opened.stack) - 1)
        node = Node(tag, attrs, opened.top())
        node.parent.children.append(node)
        if tag in ("article", "main") and not _unwanted(node):
            above = node.parent
            while above is not None and not above.holds:
                above.holds = True
                above = above.parent
        if tag in RAW:
            if lower is None:
                lower = page.lower()
                lower = lower if len(lower) == size else page
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else size
        elif tag not in VOID and (tag in BLOCK or not attrs.endswith("/")):
            opened.push(node)
    return root


def _unwanted(node: Node) -> bool:
    """By its role, visibility, class or id. Articles are unwanted only where their class says comment, teaser and the like."""
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    bad = _ASIDE_WORDS if node.tag == "article" else _BAD_WORDS
    names = []
    for m in _ATTRIBUTE.finditer(node.attrs):
        key = m[1].lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            names.append(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value))
        elif key == "role" and value.lower() in _ROLES or key == "hidden":
            return True
        elif key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return any(bad.search(_TITLE_WORDS.sub(" ", n)) for n in names) and node.tag not in HEADINGS


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents before children, without what is left out. No recursion: pages nest deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if (node.out or _unwanted(node)) and not (node.holds and node.tag not in RAW):
            node.out = True
            continue
        node.out = False
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def _blocks(root: Node) -> Iterator[str]:
    """Texts of the blocks under ``root`` in page order, white space turned into single spaces."""
    parts: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            if text := " ".join("".join(parts).split()):
                yield text
            parts = []
        elif x.out:
            continue
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag == "header" and x is not root:
            todo.extend([None, *reversed([c for c in x.children if isinstance(c, Node) and (c.tag in HEADINGS or c.tag in ("div", "hgroup"))]), None])
        elif x.tag in ("td", "th"):
            parts.append(" ")
            todo.extend(reversed(x.children))
        elif x.tag in BLOCK or x.tag == "#root":
            todo.append(None)
            todo.extend(reversed(x.children))
            todo.append(None)
        else:
            todo.extend(reversed(x.children))
    if text := " ".join("".join(parts).split()):
        yield text


def scored(order: list[Node]) -> tuple[dict[Node, float], dict[Node, float]]:
    """Each container's points, and each node's link density; ``order``: all nodes, parents before children.

    A paragraph, item, cell or heading gives its points to the nearest container above it, and half of them to
    what stands above that; a container's loose text counts as its own paragraph. Points: 1, one for each
    comma of its own text, and one for each 100 characters up to three, times the share of text outside links.
    """
    length, links, score, holder_of = {}, {}, {}, {}
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inside = [c for c in node.children if isinstance(c, Node) and not c.out]
        length[node] = own + sum(length[c] for c in inside)
        links[node] = length[node] if node.tag == "a" else sum(links[c] for c in inside)
    for node in order:
        above = node.parent
        holder_of[node] = above if above is None or above.tag in _CONTAINER or above.tag == "#root" else holder_of[above]
        loose = node.tag in _CONTAINER and sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if not (node.tag in _SCORED or loose):
            continue
        n = loose if node.tag not in _SCORED else length[node]
        if not n:
            continue
        commas = sum(c.count(",") for c in node.children if isinstance(c, str))
        points = (1 + commas + min(n / 100, 3)) * (1 - links[node] / max(1, length[node]))
        holder = node if node.tag not in _SCORED else holder_of[node]
        for share in (1.0, 0.5):
            if holder is None:
                break
            score[holder] = score.get(holder, 0.0) + points * share
            holder = holder.parent
    density = {node: links[node] / max(1, length[node]) for node in order}
    for node in score:
        score[node] *= 1 - density[node]
        if node.tag in ("article", "main"):
            score[node] += 25
        elif node.attrs and _GOOD_WORDS.search(node.attrs):
            score[node] += 10
    return score, density


def _with_siblings(best: Node, score: dict[Node, float], density: dict[Node, float]) -> list[Node | str]:
    """The best container and what belongs to it among its siblings, in page order.

    Siblings with a fifth of its points, long paragraphs and a title stay. Beside a container that is no
    ``article`` or ``main`` the text need not lie in one element: what reads like running text (few links)
    stays too where it stands between kept siblings, and next to them if it is no further container. Headings
    that nothing follows go.
    """
    near = [c for c in best.parent.children if (c.strip() if isinstance(c, str) else not c.out)]

    def long_or_title(c: Node) -> bool:
        return c.tag == "p" and density[c] < 0.25 and sum(map(len, _blocks(c))) > 80 or c.tag == "h1" and density[c] < 0.5

    kept = [not isinstance(c, str) and (c is best or score.get(c, 0.0) >= 0.2 * score[best] or long_or_title(c)) for c in near]
    if best.tag not in ("article", "main"):
        reads = [isinstance(c, str) or c.tag in _RUNNING and density[c] < 0.33 for c in near]
        alone = [r and (isinstance(c, str) or c.tag not in ("div", "section")) for c, r in zip(near, reads)]
        first, final = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        kept[first:final] = [k or r for k, r in zip(kept[first:final], reads[first:final])]
        for places in (range(first - 1, -1, -1), range(final + 1, len(near))):
            for k in places:
                if not alone[k]:
                    break
                kept[k] = True
    chosen = [c for c, k in zip(near, kept) if k]
    while len(chosen) > 1 and not isinstance(chosen[-1], str) and chosen[-1] is not best and chosen[-1].tag in HEADINGS:
        chosen.pop()
    return chosen


def extract(page: str | None) -> list[str]:
    """The blocks of the page's main text, in page order. Of containers with equal points the first is the best."""
    if not page:
        return []
    root = parse(page)
    order = _in_order(root)
    score, density = scored(order)
    if not score:
        return list(_blocks(root))
    best = max((n for n in order if n in score), key=lambda n: score[n])
    if best.parent is None or best.tag in ("body", "html"):
        return list(_blocks(best))
    return [b for c in _with_siblings(best, score, density) for b in ([" ".join(c.split())] if isinstance(c, str) else _blocks(c))]


def main_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """``(id_col, *keep, text, blocks)`` of every row: blocks joined by two line feeds, and their number.

    The whole page is read, in time linear in its length. A null or empty page, and one without article text,
    gives an empty text; of containers with equal points the first in page order is the article.
    Character references are decoded; white space inside a block (line breaks included) becomes one
    space. Repeated rows and null ids each give a row; an empty table gives none.
    """
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [extract(p) for p in batch.column(len(names)).to_pylist()]
            out = [pa.array(["\n\n".join(b) for b in blocks], pa.string()), pa.array([len(b) for b in blocks], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], names=[*names, "text", "blocks"])

    types = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", text string, blocks long"
    return pages.select(*names, F.col(html_col).alias("html_of_page")).mapInArrow(run, schema)
