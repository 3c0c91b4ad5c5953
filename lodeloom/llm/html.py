"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A trained classifier over each block's
tags, names, links and words (``html_costs``) gives what it costs to call the
block content or boilerplate; these costs are the capacities to source and sink.
Edges of smoothness join neighbours on the page and blocks to the containers
around them. The cut of least capacity labels all blocks at once.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_costs import costs, trained

#: A tag. A quoted value may hold < and >; but one that holds > and ends with = has lost its own closing quote.
_TAG = re.compile(
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)"
    r"(?P<attrs>(?:[^<>\"'=]++|=\s*+\"(?:[^\">]*+|[^\"]*+(?<!=))\"|=\s*+'(?:[^'>]*+|[^']*+(?<!=))'|[=\"'])*+)>"
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "title", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: An open element on the left ends where one on the right begins.
CLOSES = {
    "p": {"p", "div", "section", "article", "aside", "nav", "header", "footer", "main", "form", "ul", "ol", "dl", "table", "pre", "blockquote",
          "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "fieldset", "address", "details"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
BAD_TAGS = {"nav", "footer", "aside", "menu", "dialog", "button", "head", "header", "form", "fieldset"}
GOOD_TAGS = {"article", "main"}
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adslot|sponsor(?:s|ed)?|promo(?:s|tion|tions)?|banner|cookies?|consent|gdpr|notices?|alert|"
    r"popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|sidebar|side-bar|rail|widgets?|"
    r"share|sharing|social|breadcrumbs?|menu|submenu|nav|navbar|navigation|topbar|top-bar|footer|masthead|comments?|commentlist|"
    r"comment-list|disqus|respond|replies|reply|login|search|searchbox|pager|pagination|toolbar|skip|skip-link|byline-share|"
    r"sitemap|paywall)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names that stand on boilerplate and on parts of articles.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:related|recommended|header|tags|legal|copyright|disclaimer|trending|popular|teasers?|feedback|survey|form)(?:$|[\s_-])",
    re.IGNORECASE,
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_GOOD_NAME = re.compile(
    r"(?:^|[\s_-])(?:article|story|post|entry|content|main|body|text|article-body|post-content|entry-content|story-body)(?:$|[\s_-])",
    re.IGNORECASE,
)
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Capacities are whole numbers of this part.
UNIT = 1000


@dataclass
class Node:
    """An element that holds blocks."""

    name: str
    parent: int
    tag: bool = False  # boilerplate by its tag, role or state
    bad_name: bool = False
    hint: bool = False  # by a name that may mean it
    good: bool = False
    chars: int = 0


@dataclass
class Block:
    text: str
    node: int
    linked: int
    chars: int = 0
    words: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1)])
    blocks: list[Block] = field(default_factory=list)


def _evidence(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is boilerplate by its tag or state, by its name, perhaps by its name; whether it names content."""
    tag, bad, hint, good = name in BAD_TAGS, False, False, name in GOOD_TAGS
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id") and name not in ("html", "body"):
                value = _CAMEL.sub("-", value)
                if _BAD_NAME.search(value):
                    bad = True
                    tag |= name in GOOD_TAGS
                elif _HINT.search(value):
                    hint = True
                elif _GOOD_NAME.search(value):
                    good = True
            elif key == "role":
                tag |= value.lower() in _BAD_ROLE
                good |= value.lower() in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                tag = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                tag = True
    return tag, bad, hint, good


@lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE)


class _Parser:
    """Reads a page once; what is not found once is not looked for again, so time is linear in its size."""

    def __init__(self, source: str):
        self.source, self.page = source, Page()
        self.nodes, self.stack, self.open_names = self.page.nodes, [0], {}
        self.text: list[str] = []
        self.linked, self.in_link = 0, False
        self.never_closed: set[str] = set()

    def flush(self) -> None:
        if self.text:
            whole = " ".join("".join(self.text).split())
            if whole:
                self.page.blocks.append(Block(whole, self.stack[-1], self.linked, len(whole), whole.count(" ") + 1))
        self.text, self.linked = [], 0

    def add(self, run: str, plain: bool = False) -> None:
        if run:
            self.text.append(html.unescape(run) if "&" in run and not plain else run)
            if self.in_link:
                self.linked += len(run)

    def pop(self) -> None:
        self.open_names[self.nodes[self.stack.pop()].name] -= 1

    def after(self, what: str, at: int, otherwise: int) -> int:
        """Where ``what`` ends after ``at``; ``otherwise`` if it is not there."""
        found = -1 if what in self.never_closed else self.source.find(what, at)
        if found < 0:
            self.never_closed.add(what)
        return otherwise if found < 0 else found + len(what)

    def read(self) -> Page:
        source, at, n = self.source, 0, len(self.source)
        last = source.rfind(">")
        while at < n:
            lt = source.find("<", at) if last >= 0 else -1
            if lt < 0:
                self.add(source[at:])
                break
            self.add(source[at:lt])
            if lt > last:  # no tag ends any more: one that begins is lost, other text stays
                if not re.match(r"<[a-zA-Z/!?]", source[lt : lt + 2]):
                    self.add("<")
                    at = lt + 1
                    continue
                break
            if source.startswith("<!", lt) or source.startswith("<?", lt):
                at = self.declaration(lt, n)
                continue
            m = _TAG.match(source, lt)
            if not m:
                self.add("<")
                at = lt + 1
                continue
            at = m.end()
            if m["end"]:
                self.end(m["name"].lower())
            else:
                at = self.start(m["name"].lower(), m["attrs"], at, n)
        self.flush()
        return self.page

    def declaration(self, lt: int, n: int) -> int:
        """Comments, CDATA sections, whose text is taken as it is, and all else that is no element: up to its >."""
        if self.source.startswith("<!--", lt):
            return self.after("-->", lt + 2, n)
        if self.source.startswith("<![CDATA[", lt):
            end = self.after("]]>", lt, -1)
            if end >= 0:
                self.add(self.source[lt + 9 : end - 3], plain=True)
                return end
        return self.after(">", lt, n)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if self.open_names.get(name):
            self.flush()
            while self.nodes[self.stack[-1]].name != name:
                self.pop()
            self.pop()
        elif name not in INLINE:
            self.flush()

    def start(self, name: str, attrs: str, at: int, n: int) -> int:
        """Open an element; where reading goes on."""
        if name in VOID:
            if name in ("br", "hr", "img"):
                self.text.append(" ")
                if name == "hr":
                    self.flush()
            return at
        if name in RAW:
            if attrs.endswith("/"):
                return at
            found = None if name in self.never_closed else _closing(name).search(self.source, at)
            if not found:
                self.never_closed.add(name)
                return n if name in ("script", "style", "textarea", "title") else at
            return found.end()
        if name == "a":
            self.in_link = True
        evidence = _evidence(name, attrs)
        if name in INLINE and not any(evidence[:3]):
            return at
        self.flush()
        while len(self.stack) > 1 and name in CLOSES.get(self.nodes[self.stack[-1]].name, ()):
            self.pop()
        if not (attrs.rstrip().endswith("/") and name in INLINE):
            self.nodes.append(Node(name, self.stack[-1], *evidence))
            self.stack.append(len(self.nodes) - 1)
            self.open_names[name] = self.open_names.get(name, 0) + 1
        return at


def parse(source: str) -> Page:
    """Blocks and the elements around them; markup that is broken is read as browsers do, roughly."""
    page = _Parser(source).read()
    nodes = page.nodes
    for b in page.blocks:
        nodes[b.node].chars += b.chars
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].chars += nodes[k].chars
    return page


SMOOTH_NEXT, SMOOTH_FAR, SMOOTH_TREE = 1.2, 0.3, 0.6


def graph(page: Page, weights: tuple[float, ...]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal capacities (positive: to the source, which means content) and smoothness edges.

    Vertices are the blocks, then one for each element that holds blocks.
    """
    terminals = [round(UNIT * s) for s in costs(page, weights)]
    nodes, blocks = page.nodes, page.blocks
    vertex: dict[int, int] = {}
    edges = []
    for i, b in enumerate(blocks):
        if i:
            before = blocks[i - 1].node
            near = before == b.node or nodes[before].parent == nodes[b.node].parent
            edges.append((i - 1, i, round(UNIT * (SMOOTH_NEXT if near else SMOOTH_FAR))))
        k, child = b.node, i
        while k > 0:
            known = k in vertex
            v = vertex.setdefault(k, len(blocks) + len(vertex))
            edges.append((child, v, round(UNIT * SMOOTH_TREE / (1 + (child >= len(blocks))))))
            if known:
                break
            k, child = nodes[k].parent, v
    return terminals + [0] * len(vertex), edges


def min_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which vertices stay on the source's side of a minimum cut (the largest such side).

    A vertex whose own capacity is no less than that of all its edges is on its
    side whatever the others are; its edges then count for its neighbours. Most
    vertices go this way, in time linear in the edges. Between the others the
    largest flow is found by levels (Dinic).
    """
    n = len(terminals)
    own = list(terminals)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    spare = [0] * n
    for u, v, c in edges:
        near[u].append((v, c))
        near[v].append((u, c))
        spare[u] += c
        spare[v] += c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        u = queue.popleft()
        if side[u] is not None or -spare[u] <= own[u] < spare[u]:
            continue
        side[u] = own[u] > 0 or own[u] == spare[u]
        for v, c in near[u]:
            if side[v] is None:
                spare[v] -= c
                own[v] += c if side[u] else -c
                queue.append(v)
    rest = [u for u in range(n) if side[u] is None]
    if rest:
        at = {u: k for k, u in enumerate(rest)}
        kept = [(at[u], at[v], c) for u, v, c in edges if side[u] is None and side[v] is None]
        for u, content in zip(rest, _flow_cut([own[u] for u in rest], kept), strict=True):
            side[u] = content
    return side


def _flow_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """``min_cut`` by the largest flow; what a vertex could send to itself is settled from the start."""
    n = len(terminals)
    near: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for u, v, c in edges:
        near[u].append(len(head))
        near[v].append(len(head) + 1)
        head += (v, u)
        room += (c, c)
    give = [max(t, 0) for t in terminals]
    take = [max(-t, 0) for t in terminals]
    while True:
        level = [0 if g else -1 for g in give]
        layer, depth, met = [u for u in range(n) if give[u]], 0, False
        while layer and not met:
            depth, after = depth + 1, []
            for u in layer:
                for e in near[u]:
                    v = head[e]
                    if room[e] and level[v] < 0:
                        level[v] = depth
                        after.append(v)
                        met = met or take[v] > 0
            layer = after
        if not met:
            break
        tried = [0] * n
        for source in range(n):
            if level[source] == 0:
                _send(source, give, take, near, head, room, level, tried)
    # Content is what cannot reach spare sink capacity: ties go to content.
    seen = [t > 0 for t in take]
    queue = deque(u for u in range(n) if seen[u])
    while queue:
        v = queue.popleft()
        for e in near[v]:
            u = head[e]
            if room[e ^ 1] and not seen[u]:
                seen[u] = True
                queue.append(u)
    return [not x for x in seen]


def _send(source: int, give: list, take: list, near: list, head: list, room: list, level: list, tried: list) -> None:
    """Send what ``source`` has along edges that lead one level on; an edge that leads nowhere is tried once."""
    path, u = [], source
    while give[source]:
        if take[u]:
            least = min(give[source], take[u], *(room[e] for e in path))
            give[source] -= least
            take[u] -= least
            cut = len(path)
            for k in range(len(path) - 1, -1, -1):
                e = path[k]
                room[e] -= least
                room[e ^ 1] += least
                if not room[e]:
                    cut = k
            if cut < len(path):
                u = head[path[cut] ^ 1]
                del path[cut:]
            continue
        while tried[u] < len(near[u]):
            e = near[u][tried[u]]
            if room[e] and level[head[e]] == level[u] + 1:
                break
            tried[u] += 1
        else:
            if not path:
                return
            u = head[path.pop() ^ 1]
            tried[u] += 1
            continue
        path.append(e)
        u = head[e]


def main_text(source: str | None, weights: tuple[float, ...] | None = None) -> str:
    """Content blocks in page order, joined by one space; empty if there are none.

    A null or empty page gives the empty text; a page without markup is one
    block, which is content by its words alone.
    """
    if not source:
        return ""
    page = parse(source)
    if not page.blocks:
        return ""
    if len(page.nodes) == 1:
        return " ".join(b.text for b in page.blocks)
    side = min_cut(*graph(page, weights or trained()))
    return " ".join(b.text for b, content in zip(page.blocks, side, strict=False) if content)


def _run(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    Rows are independent: repeated rows and null ids or URLs stay as they are.
    A null or empty html gives the empty text and n_chars 0; a page's text ends
    where a tag is begun that never ends. Other columns are ignored. Empty
    table: no rows.
    """
    out = pages.select("page_id", "url", "html").mapInArrow(_run(trained()), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
