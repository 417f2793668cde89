"""Main-text extraction from HTML by tree scoring.

A page is read into a tree (open paragraphs, items and cells close where HTML lets them).
Menus, headers, footers, sidebars, forms, scripts and parts whose class, id or role says
advert, notice, comments and the like are cut out, unless they hold the page's article or
most of its text. An article's header that has a heading stays. Every paragraph then passes points for
its length and commas to its ancestors, in full to the parent, half to the next one and a
third of that for every level above, each
container's sum is discounted by its share of link text, and the best container is kept,
with those siblings whose points or prose come near. A best container inside an article
element stands for the whole article. Lists of links inside what is kept are menus and go.

Every step takes time in proportion to the page, however deep its elements nest.

Text comes out as blocks in page order, white space inside a block as one space, two line
feeds between blocks.

Defined results: a null or empty page and one without text give the empty text; broken
markup never fails: an unclosed comment, script or tag runs to the end; repeated rows get
equal results; columns other than id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import texts_of

#: Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("head title script style template noscript nav header footer aside form button select textarea iframe svg "
                "object canvas audio video dialog menu input".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
#: Where such a search stops.
LIMIT = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
#: What start tags close, and where the search stops, once for every rule; the first one is that of blocks.
_RULES = [({"p"}, {"td", "th", "table", "li", "blockquote", "div", "article", "section", "main", "figure", "button"}),
          *((CLOSES[k], LIMIT.get(k, set())) for k in CLOSES)]
_RULE = {k: i for i, k in enumerate(CLOSES, 1)}
_RULED = frozenset().union(*(a | b for a, b in _RULES))
#: Words in class, id or role that mark parts beside the article.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-bar|rail|nav(?:bar|igation)?|menu|"
    r"breadcrumbs?|footer|masthead|comments?|comment-list|disqus|replies|respond|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|paywall|share|sharing|social|related|recommended|recirc|pagination|pager|login|signin|signup|search|toolbar|"
    r"complementary|contentinfo|alert|dialog|widget)(?:$|[\s_-])", re.I)
#: Class words that tell of a part elsewhere or of a state, not what the element is.
STATE = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|with|without|is|not|hide|show)[-_]\S+|\S+[-_](?:open|opened|closed|enabled|disabled|active|inactive|visible|"
                   r"hidden|collapsed|expanded|on|off))(?=\s|$)", re.I)
#: Cut elements without text of the page.
HARD = frozenset("head title script style template noscript button select textarea iframe svg object canvas audio video input".split())
#: From these shares of the page's text a part is not cut: alone, or beside an article.
MOST, MOST_BESIDE = 0.5, 0.8
_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+>")
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"""\sstyle\s*=\s*(?:"[^"]*?display\s*:\s*none|'[^']*?display\s*:\s*none|display:none)""", re.I)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Share of link text from which a part is a menu.
LINKED = 0.5
#: A list with this share of link text and two links is a menu, wherever it stands.
MENU = 0.8
#: Siblings stay from this share of the best container's points.
SIBLING = 0.2


class Node:
    __slots__ = ("name", "parent", "parts", "cut", "points", "marks", "linked", "ends", "menu")

    def __init__(self, name: str, parent: "Node | None", cut: bool) -> None:
        self.name, self.parent, self.cut, self.points = name, parent, cut, 0.0
        self.marks, self.linked, self.menu = "", 0.0, False
        self.parts: list = []
        # for every rule the outermost open element that its start tag ends; most elements share their parent's
        above = parent.ends if parent else (None,) * len(_RULES)
        self.ends = above if name not in _RULED or parent is None else tuple(
            None if name in limit else (up or self if name in names else up) for up, (names, limit) in zip(above, _RULES))


def tree(html: str) -> Node:
    """The page's elements; text parts are strings."""
    root = here = Node("html", None, False)
    opened: Counter[str] = Counter()  # open elements by name
    headers: list[Node] = []  # open headers of articles

    def leave(node: Node) -> Node:
        """Closes the open elements up to this one; its parent."""
        up = here
        while True:
            opened[up.name] -= 1
            if headers and headers[-1] is up:
                headers.pop()
            if up is node:
                return node.parent
            up = up.parent

    at, n, lower = 0, len(html), None
    while at < n:
        found = _TAG.search(html, at)
        stop = found.start() if found else n
        if stop > at:
            here.parts.append(html[at:stop])
        if not found:
            break
        if html.startswith("<!--", stop):
            end = html.find("-->", stop + 4)
            at = n if end < 0 else end + 3
            continue
        rest = _REST.match(html, stop + 1)
        end = rest.end() if rest else (html.find(">", stop) + 1 or n)
        tag, at = html[stop + 1:end].rstrip(">"), end
        if tag[:1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[0] == "/":
            if opened[name]:
                node = here
                while node.name != name:
                    node = node.parent
                here = leave(node)
            elif name == "p":  # ends a paragraph that has ended: an empty one
                here.parts.append(Node("p", here, False))
            continue
        if name in ("html", "body") and here is root:
            continue
        if (name == "p" or name in BLOCK) and here.ends[0]:
            here = leave(here.ends[0])
        if name in _RULE and here.ends[_RULE[name]]:
            here = leave(here.ends[_RULE[name]])
        marks = " ".join(a or b or c for a, b, c in _MARK.findall(tag))
        beside = bool(marks and ASIDE.search(STATE.sub("", marks))) and name not in ("body", "article", "main") and name not in HEADING
        node = Node(name, here, beside or name in CUT or name == "label" and not opened["p"] or _unseen(tag))
        if name in HEADING and headers:
            headers[-1].cut = False
        kind = _CLASS.search(tag)
        node.marks = (kind[1] or kind[2] or kind[3] or "").strip() if kind else ""
        here.parts.append(node)
        if name in RAW:
            lower = html.lower() if lower is None else lower
            end = lower.find("</" + name, at)
            at = n if end < 0 else end
            if end >= 0:
                here_end = html.find(">", end)
                at = n if here_end < 0 else here_end + 1
        elif name not in VOID and not tag.endswith("/"):
            here = node
            opened[name] += 1
            if name == "header" and opened["article"] and not beside:
                headers.append(node)
    return root


def _unseen(tag: str) -> bool:
    """Whether a start tag hides its element."""
    low = tag.lower()
    return "hidden" in low and bool(_HIDDEN.search(_VALUE.sub('""', tag))) or "display" in low and bool(_UNSEEN.search(tag))


def _restore(root: Node) -> bool:
    """Takes back cuts of parts that hold the article or most of the page's text; whether there were any."""
    weight: dict[int, int] = {}  # characters outside links of a subtree, cut or not
    holds: set[int] = set()  # subtrees with an article or main element that has text
    tops: list[Node] = []
    stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    shown = seen = 0  # text outside of cut parts, and in articles there
    while stack:
        node, left, cut, article = stack.pop()
        if node.name in HARD or node.name == "a":
            continue
        cut, article = cut or node.cut, article or node.name in ("article", "main")
        inner = [c for c in node.parts if isinstance(c, Node)]
        if not left:
            if node.cut:
                tops.append(node)
            stack.append((node, True, cut, article))
            stack.extend((c, False, cut, article) for c in inner)
            continue
        own = sum(len(c.strip()) for c in node.parts if isinstance(c, str))
        weight[id(node)] = own + sum(weight.get(id(c), 0) for c in inner)
        if not cut:
            shown, seen = shown + own, seen + own * article
        if weight[id(node)] and (node.name in ("article", "main") or any(id(c) in holds for c in inner)):
            holds.add(id(node))
    total = weight.get(id(root), 0)
    found = False
    free: set[int] = set()  # taken back, with all above
    for node in sorted(tops, key=lambda n: -weight[id(n)]):  # outer parts before the equal ones that they hold
        size = weight[id(node)]
        if not (size > MOST_BESIDE * total or not seen and (size > MOST * total or id(node) in holds and size >= shown)):
            continue
        up = node
        while up is not None and id(up) not in free:
            free.add(id(up))
            up.cut, up = False, up.parent
        found = True
        if size <= MOST_BESIDE * total:  # the next ones depend on what is shown now
            break
    return found


def blocks(node: Node, menus: bool = True) -> list[str]:
    """Text blocks of a subtree in page order, without the cut parts and, if so told, without lists of links."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            run.append(part)
        elif not part.cut and (menus or not part.menu):
            if part.name == "br":
                run.append(" ")
                continue
            if part.name in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(part.parts))
    end()
    return out


def _scored(root: Node) -> list[Node]:
    """Gives points to containers; returns those that got any, in page order."""
    texts: dict[int, list] = {}
    order: list[Node] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    sizes: dict[int, tuple] = {}  # of a subtree: characters, link characters, of its paragraph: commas, characters; links

    while stack:
        node, left = stack.pop()
        if not left:
            if node.cut:
                continue
            order.append(node)
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.parts) if isinstance(c, Node))
            continue
        own = "".join(c for c in node.parts if isinstance(c, str))
        size, links = len(own.strip()), 0
        commas = own.count(",")
        inline, anchors = len(own.strip()), int(node.name == "a")
        for c in node.parts:
            if isinstance(c, Node) and not c.cut:
                s, link, more, run, n = sizes[id(c)]
                size, links, anchors = size + s, links + link, anchors + n
                if c.name not in BLOCK:
                    commas, inline = commas + more, inline + run
        if node.name == "a":
            links = size
        sizes[id(node)] = size, links, commas, inline, anchors
        if inline and (node.name in PARAGRAPH or node.name in BLOCK):
            texts[id(node)] = [node, inline, commas]
    far: dict[int, float] = {}  # what comes from below the children
    for node, inline, commas in texts.values():
        # loose text of a container counts for the container itself
        to = node.parent if node.name in PARAGRAPH else node
        if to is not None:
            to.points += 1 + commas + min(inline / 100, 3.0)
    for node in reversed(order):
        below, own = far.get(id(node), 0.0), node.points
        if node.parent is not None:
            far[id(node.parent)] = far.get(id(node.parent), 0.0) + own / 2 + below / 3
        size, links, _, _, anchors = sizes[id(node)]
        node.linked = links / size if size else 0.0
        node.points = (own + below) * (1 - node.linked) if size else 0.0
        node.menu = node.name in LISTS and anchors > 1 and node.linked >= MENU
    return [n for n in order if n.points > 0]


def main_text(html: str) -> str:
    """The article's text."""
    root = tree(html)
    while _restore(root):
        pass
    scored = _scored(root)
    if not scored:
        return "\n\n".join(blocks(root))
    best = max(scored, key=lambda n: n.points)  # ties: the first in page order
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None and (up.name == "main" or up.parent is None):
        return _text(up)
    if best.parent is None:
        return _text(best)
    chosen = up or best
    parts = [c for c in chosen.parent.parts if isinstance(c, str) or not c.cut]
    keep = [not isinstance(c, str) and _stays(c, chosen, up is not None) for c in parts]
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    whole = Node("div", None, False)
    for at, part in enumerate(parts):
        loose = isinstance(part, str) or part.name not in BLOCK
        between = first < at < last and (isinstance(part, str) or part.linked < LINKED)
        # loose text around the best container is the parent's own; around articles only between them
        if keep[at] or between or loose and up is None and (isinstance(part, str) or part.linked < LINKED):
            whole.parts.append(part)
    return _text(whole)


def _text(node: Node) -> str:
    """The blocks of what is kept; where all of it is lists of links, these are the text."""
    return "\n\n".join(blocks(node, menus=False) or blocks(node))


def _stays(node: Node, best: Node, articles: bool) -> bool:
    """Whether a sibling belongs to the best container (or, of an article, is one as well)."""
    if node is best:
        return True
    if articles:
        return node.name == "article" and node.points > 0 and node.linked < LINKED
    text = blocks(node)
    prose = node.name in PARAGRAPH and (len("".join(text)) > 80 or node.name[0] == "h")
    return node.points >= SIBLING * best.points or prose or (
        node.name == best.name and node.marks == best.marks and node.linked < LINKED and node.name in BLOCK and _paragraph(node))


def _paragraph(node: Node) -> bool:
    """Whether an uncut paragraph element with text lies inside."""
    stack = [(node, False)]
    while stack:
        node, inside = stack.pop()
        for c in node.parts:
            if isinstance(c, str):
                if inside and unescape(c).strip():
                    return True
            elif not c.cut:
                stack.append((c, inside or c.name in PARAGRAPH and c.name != "li"))
    return False


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    return rows.mapInArrow(step, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
