"""Main-text extraction from HTML by minimum-cut labelling of blocks.

A page becomes a list of text blocks, each with its DOM path.  A hand-set linear
classifier turns a block's place (article, navigation, advert, ...), length, link
density and punctuation into the cost of calling it content or boilerplate; these
are the capacities to the two terminals.  Blocks that follow each other, and
blocks of one parent that do not, are tied by smoothness edges that cost the more
to cut the closer they are in the DOM.  The minimum cut gives the labelling of
least total cost.  Blocks whose terminal outweighs all their ties are labelled
first, which leaves most pages without any search; the rest is solved by blocking
flows.  Reading a page takes time in proportion to its length, however deep or broken
its markup: open elements are kept by tag, so no end tag walks the stack in vain.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose contents are never text, and such as hold raw text up to their end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
DROPPED = RAW | {"head", "svg", "select", "object", "canvas", "audio", "video", "datalist"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: What an open element of a kind closes when another begins (HTML's optional end tags).
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}
LISTS = {"ul", "ol", "dl", "menu", "table"}

BOILER_TAGS = {"nav": 8.0, "header": 5.0, "footer": 9.0, "aside": 8.0, "form": 9.0, "menu": 8.0, "dialog": 9.0,
               "fieldset": 9.0, "legend": 9.0, "label": 3.0, "address": 2.0}
#: Ties of neighbours in page order (over 1 + their distance), and of siblings of one tag and class or of others.
NEIGHBOUR, ALIKE, UNLIKE = 0.8, 2.0, 0.5
CONTENT_TAGS = {"article": 4.0, "main": 3.0}
_BOILER_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|header|masthead|footer|foot|"
    r"side-?bar\w*|aside|widget\w*|comment\w*|disqus\w*|reply|replies|respond|discussion|cookie\w*|consent|gdpr|"
    r"notice\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|share|sharing|social\w*|"
    r"related\w*|recommend\w*|breadcrumb\w*|pagination|pager|toolbar|copyright|legal|disclaimer|search\w*|form|"
    r"skip\w*|tags?|outbrain|taboola)(?:$|[^a-z])"
)
#: Names that an article's own parts may have too.
_DOUBTFUL_NAME = re.compile(r"(?:^|[^a-z])(?:legal|disclaimer|copyright|foot|header|tags?|form|search\w*|reply|replies|discussion)(?:$|[^a-z])")
_CONTENT_NAME = re.compile(
    r"(?:^|[^a-z])(?:article\w*|content|main|post|entry|story\w*|body|text|page-content|post-content|prose)(?:$|[^a-z])"
)
_ROLES = {"navigation": 8.0, "banner": 6.0, "contentinfo": 9.0, "complementary": 8.0, "search": 9.0, "form": 9.0,
          "dialog": 9.0, "alert": 9.0, "alertdialog": 9.0, "menu": 8.0, "menubar": 8.0}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"  # a quote that is not closed ends with the tag
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


@dataclass
class Node:
    """An open element: its bias towards boilerplate (+) or content (-), and whether its text is dropped."""

    tag: str
    look: str
    number: int
    depth: int
    bias: float
    dropped: bool
    parent: Node | None
    inside: bool = False  # an article or main element
    within: bool = False  # that, or an element whose name says so
    in_p: bool = False  # the nearest block is an open paragraph


@dataclass
class Block:
    text: str
    links: int
    node: Node
    tag: str
    cost: float = field(default=0.0)


def _bias(tag: str, attributes: str, within: bool) -> tuple[float, bool, bool]:
    """The bias that an element adds for all below it, whether it is hidden, and whether its name is that of a text."""
    score, hidden, named = 0.0, False, False
    if tag in BOILER_TAGS:
        score += BOILER_TAGS[tag] if not (within and tag == "header") else 1.0
    elif tag in CONTENT_TAGS:
        score -= CONTENT_TAGS[tag]
    if attributes:
        for m in _NAMES.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                if within and _DOUBTFUL_NAME.search(value) and not _BOILER_NAME.search(_DOUBTFUL_NAME.sub(" ", value)):
                    score += 3.0
                elif _BOILER_NAME.search(value):
                    score += 8.0 if tag not in ("body", "html") else 0.0
                elif _CONTENT_NAME.search(value):
                    score -= 2.0
                    named = tag not in ("body", "html")
            elif name == "role":
                score += _ROLES.get(value, -2.0 if value in ("main", "article") else 0.0)
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= name == "hidden" or value == "true"
    return score, hidden, named and score < 0


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    root = Node("", "", 0, 0, 0.0, False, None)
    top, count = root, 0
    out: list[Block] = []
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)
    opened: dict[str, list[Node]] = {}  # the open elements of each tag, outermost first
    lists: list[Node] = []

    def close(node: Node) -> None:
        """Closes the open elements down to ``node``."""
        nonlocal top
        while top is not node.parent:
            opened[top.tag].pop()
            if top.tag in LISTS:
                lists.pop()
            top = top.parent

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, links, top, top.tag))
            parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not top.dropped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if linked:
                links += len(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            if tag == "a":
                linked = max(0, linked - 1)
            if tag == "p" or tag in BLOCK:
                flush()
            node = opened[tag][-1] if opened.get(tag) else None
            if node is not None and not (tag in CLOSED_BY and lists and lists[-1].depth > node.depth):
                close(node)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            while top.tag == "p" or top.tag in ("b", "i", "em", "strong", "u", "span", "a", "font", "small") and top.in_p:
                linked = 0 if top.tag == "a" else linked
                close(top)
        if tag in CLOSED_BY.get(top.tag, ()):
            close(top)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        bias, hidden, named = _bias(tag, attributes, top.within)
        hidden |= tag == "button" and not top.in_p
        count += 1
        top = Node(
            tag, attributes.strip(), count, top.depth + 1, top.bias + bias, top.dropped or hidden or tag in DROPPED, top,
            top.inside or tag in CONTENT_TAGS, top.within or named or tag in CONTENT_TAGS, tag == "p" or (tag not in BLOCK and top.in_p),
        )
        opened.setdefault(tag, []).append(top)
        if tag in LISTS:
            lists.append(top)
        if tag == "a":
            linked += 1
    flush()
    return out


def classify(blocks: Sequence[Block]) -> list[float]:
    """Cost of calling each block content minus that of calling it boilerplate."""
    article = any(b.node.inside for b in blocks)
    costs = []
    for b in blocks:
        size = len(b.text)
        cost = b.node.bias
        density = b.links / size
        cost += 4.0 * density - (0.0 if density > 0.5 else min(size, 400) / 100)
        if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"):
            cost -= 1.0
        if b.text[-1] in ".!?…:;»”\"":
            cost -= 0.5
        if article and not b.node.inside:
            cost += 6.0
        elif not article and size < 40 and b.tag != "p":
            cost += 1.0
        if b.text[0] == "©":
            cost += 3.0
        costs.append(cost)
    return costs


def ties(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and the next block of one container."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        home = b.node.parent if b.node.parent is not None else b.node
        if i:
            edges.append((i - 1, i, NEIGHBOUR / (1 + _distance(blocks[i - 1].node, b.node))))
        j = last.get(home.number)
        if j is not None:
            a = blocks[j].node
            edges.append((j, i, ALIKE if (a.tag, a.look) == (b.node.tag, b.node.look) else UNLIKE))
        last[home.number] = i
    return edges


def _distance(a: Node, b: Node) -> int:
    """Steps between two elements in the DOM."""
    steps = 0
    while a.number != b.number:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(costs: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost.

    cost[i] is paid, if positive, by content and, if negative, by boilerplate
    (its amount); each edge is paid if its ends differ.  Of several best
    labellings, the one with the fewest content blocks.
    """
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    pull = list(costs)
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a block that outweighs all its ties is decided; its ties then pull at the others
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > sum(near[i].values()) + 1e-12:
            label[i] = pull[i] < 0
            for j, w in near[i].items():
                del near[j][i]
                if label[j] is None:
                    pull[j] += -w if label[i] else w
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _max_flow(rest, pull, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _max_flow(rest: list[int], pull: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocks on the content side of the cut: those that residual flow from the source reaches.

    The source feeds blocks that want to be content; the sink takes from the others.
    Blocking flows: each phase ranks blocks by their distance from the source and fills
    all shortest paths, trying no edge twice.
    """
    supply = {i: -pull[i] for i in rest if pull[i] < 0}
    demand = {i: pull[i] for i in rest if pull[i] > 0}
    residual = {i: dict(near[i]) for i in rest}
    while True:
        level = {i: 0 for i in rest if supply.get(i, 0.0) > 1e-12}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            found |= demand.get(i, 0.0) > 1e-12
            for j, w in residual[i].items():
                if w > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return set(level)
        near_of, at = {i: list(residual[i]) for i in level}, dict.fromkeys(level, 0)
        for start in [i for i, k in level.items() if k == 0]:
            path = [start]
            while path:
                i = path[-1]
                if demand.get(i, 0.0) > 1e-12:
                    flow = min(supply[start], demand[i], *(residual[a][b] for a, b in zip(path, path[1:], strict=False)))
                    supply[start] -= flow
                    demand[i] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        residual[a][b] -= flow
                        residual[b][a] += flow
                    if supply[start] <= 1e-12:
                        break
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if residual[a][b] <= 1e-12), None)
                    if full is not None:
                        del path[full + 1 :]
                    continue
                while at[i] < len(near_of[i]):
                    j = near_of[i][at[i]]
                    if residual[i][j] > 1e-12 and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                    at[i] += 1
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1


def main_text(page: str | None) -> str:
    """The content blocks of a page, one per line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = minimum_cut(classify(blocks), ties(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` with the main text of each page.

    Null and empty pages, and pages without content, give an empty text; an
    empty table gives an empty result.  Pages are read whole, in time that
    follows their length (some seconds for 4 MB of any markup); markup cut off
    at the end is read as far as it goes.  Repeated rows give equal texts, each
    by itself; nothing is compared across rows, so there are no ties.  A
    column named ``text_col`` is replaced, all others pass through.
    """

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return df.withColumn(text_col, run(df[html_col]))
