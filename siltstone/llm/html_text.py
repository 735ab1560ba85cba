"""Main text of raw web pages by tree scoring.

A page is read into a tree with HTML's implied end tags.  Elements that are
never article text by their kind or role are pruned; so are containers whose
class or id names such a part, unless they hold the page's heading or its main
element, and text elements so named if they are advertising or mostly links.
Each paragraph earns points for its length and commas and passes them to its
ancestors, less with each level; a container's points are discounted by its
link density, and elements and names that tell an article add to them.  The
best container is kept with those of its siblings that hold text of its kind;
an article or main element around it is kept as a whole if its own points are
a fifth of the best ones at least.  Nothing inside what is kept is dropped.

Each page is handled by itself inside a task, in time linear in its length:
there is no shuffle, and memory is bounded by one batch of pages.

Edge cases: a null or empty html gives an empty text; text without tags is
taken as it is; unclosed tags and comments end with the page; repeated rows
give repeated results; ties go to the earlier container; nesting of any depth
is handled without recursion; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame basefont bgsound".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("html head body button caption legend option optgroup tbody td tfoot th thead tr select".split())
# Elements that are never article text, and roles likewise.
DROPPED = frozenset("nav aside footer form script style noscript template iframe object embed svg math canvas button select input textarea dialog menu head title datalist label fieldset map audio video noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status note".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words in a class or id that tell parts that are not the article, parts that are, and leads that only say that such a part exists.
AGAINST = frozenset(
    "ad ads advert advertisement advertising adbox adslot adsense sponsor sponsored promo promotion promoted banner billboard cookie cookies consent gdpr notice notices notification alert popup popover modal overlay"
    " interstitial sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer foot footnav masthead topbar header comment comments commentlist disqus reply replies respond"
    " discussion feedback share sharing social related recommended recommendation recommendations newsletter subscribe subscription signup login signin form search searchbox widget widgets toolbar pager pagination"
    " paging skip hidden disclaimer copyright outbrain taboola shoutbox trackback trackbacks pingback teaser teasers paywall".split()
)
ADVERTS = frozenset("ad ads advert advertisement advertising adbox adslot adsense sponsor sponsored promo promotion promoted banner outbrain taboola cookie cookies consent gdpr".split())
FOR = frozenset("article body content entry main post story text page column hentry blog prose".split())
LEADS = frozenset("has with no without is not".split())
LINKS_ALLOWED = 0.6
#: Elements that hold text themselves; their names count less than those of containers.
TEXTUAL = frozenset("p pre blockquote td th dd dt li figcaption".split())
CORE = ("article", "main")
LEAST = 0.2

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|["'])*+)(?:>|\Z)|[!?][^>]*+(?:>|\Z)|/(?=[^a-zA-Z])[^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "against", "advert", "weight", "length", "linked", "links", "commas", "blocks", "own", "gone", "points", "block", "inside", "core")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        #: nearest block around it, and whether an article or main element is around it
        self.block = parent if parent is None or parent.tag in BLOCK or parent.parent is None else parent.block
        self.inside = parent is not None and (parent.inside or parent.tag in CORE)
        self.against = self.advert = self.gone = self.core = False
        self.weight = self.length = self.linked = self.links = self.commas = self.own = 0
        self.blocks = False
        self.points = 0.0


def _judge_names(node: Node, value: str) -> None:
    """Mark a node for the words of a class or id."""
    for name in value.split():
        parts = [x.lower() for x in NAMES.findall(name)]
        if not parts or any(x in LEADS for x in parts):
            continue
        if any(x in AGAINST for x in parts):
            node.against = True
            node.advert |= any(x in ADVERTS for x in parts)
        elif any(x in FOR for x in parts):
            node.weight = 25


def _read_attributes(node: Node, source: str) -> None:
    for m in ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            _judge_names(node, html.unescape(value))
        elif name == "role":
            node.gone |= value.strip().lower() in ROLES
            if value.strip().lower() in ("main", "article"):
                node.weight = 25
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and UNSEEN.search(value)):
            node.gone = True


P_SCOPE = frozenset("td th table button object caption body html div section article aside main nav header footer form ul ol dl li blockquote fieldset".split())
ANYWHERE = frozenset("table tbody thead tfoot html body article main section".split())
#: Elements over which an end tag does not reach, by the name of the scope.
SCOPES = {
    "none": frozenset(),
    "block": BLOCK,
    "p": P_SCOPE,
    "list": frozenset("ul ol menu dir table body".split()),
    "row": frozenset("table body".split()),
    "cell": frozenset("table body tr".split()),
    "line": frozenset("table body tbody".split()),
    "dl": frozenset("dl body".split()),
    "select": frozenset("select datalist".split()),
    "table": frozenset(("table",)),
}
SCOPES_OF: dict[str, list[str]] = {}
for _name, _tags in SCOPES.items():
    for _tag in _tags:
        SCOPES_OF.setdefault(_tag, []).append(_name)


class Open:
    """The open elements, with the places of each kind and scope, so that each step takes constant time."""

    def __init__(self, root: Node):
        self.stack, self.places, self.scopes = [root], {}, {name: [] for name in SCOPES}

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        for name in SCOPES_OF.get(node.tag, ()):
            self.scopes[name].append(at)

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.places[tag].pop()
        for name in SCOPES_OF.get(tag, ()):
            self.scopes[name].pop()

    def close(self, scope: str, *tags: str) -> None:
        """End the innermost open element of ``tags``, if no other element of the scope is inside it."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        limit = self.scopes[scope]
        if at and (not limit or limit[-1] <= at):
            while len(self.stack) > at:
                self.pop()


def tree(source: str) -> list[Node]:
    """Nodes of a page in document order, the root first."""
    root = Node("#root", None)
    nodes, open_, at, n = [root], Open(root), 0, len(source)
    stack = open_.stack

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].parts.append(html.unescape(source[a:b]))

    while at < n:
        m = TAG.search(source, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag == "p":
                open_.close("p", "p")
            else:
                open_.close("block" if tag not in BLOCK else "none" if tag in ANYWHERE else "table", tag)
            continue
        if tag in ENDS_P:
            open_.close("p", "p")
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                open_.pop()
        if tag == "li":
            open_.close("list", "li")
        elif tag in ("dt", "dd"):
            open_.close("dl", "dt", "dd")
        elif tag in ("td", "th"):
            open_.close("cell", "td", "th")
        elif tag == "tr":
            open_.close("line", "tr")
        elif tag in ("tbody", "thead", "tfoot"):
            open_.close("row", "tbody", "thead", "tfoot")
        elif tag == "option":
            open_.close("select", "option")
        elif tag == "a":
            open_.close("block", "a")
        elif tag == "body":
            open_.close("none", "head")
        node = Node(tag, stack[-1])
        stack[-1].parts.append(node)
        nodes.append(node)
        if m[3]:
            _read_attributes(node, m[3])
        if tag in RAW and not (tag in ("svg", "math") and m[3].endswith("/")):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID:
            open_.push(node)
    return nodes


def prune(nodes: list[Node], by_name: bool = True) -> None:
    """Mark what is not article text; a header inside an article keeps its headings."""
    for node in nodes[1:]:
        up = node.parent
        if up.gone or node.tag in DROPPED or node.tag in RAW or (node.tag == "header" and not node.inside):
            node.gone = True
        elif up.tag == "header" and node.tag in BLOCK and node.tag not in HEADINGS and node.tag != "div":
            node.gone = True
    if not by_name:
        return
    measure(nodes)
    single = sum(node.tag == "article" for node in nodes) == 1
    for node in reversed(nodes):
        node.core |= not node.gone and not (node.against and node.tag == "article") and (node.tag in ("main", "h1") or (single and node.tag == "article"))
        if node.core and node.parent is not None:
            node.parent.core = True
    for node in nodes[1:]:
        if node.parent.gone:
            node.gone = True
        elif node.against and not node.core and node.tag not in ("html", "body"):
            if node.tag in TEXTUAL or node.tag not in BLOCK:
                node.gone = node.advert or (node.linked > 0 and density(node) > LINKS_ALLOWED)
            elif node.tag not in HEADINGS or not node.inside:
                node.gone = True


def measure(nodes: list[Node]) -> None:
    """Text, link and comma counts of each node that is left, from the leaves up."""
    for node in nodes:
        node.length = node.linked = node.links = node.commas = node.own = 0
        node.blocks = False
        node.points = 0.0
    for node in reversed(nodes):
        if node.gone:
            continue
        for x in node.parts:
            if isinstance(x, str):
                size = len(x.strip())
                node.length += size
                node.own += size
                node.commas += x.count(",") + x.count("，") + x.count("、") + x.count("،")
        if node.tag == "a":
            node.linked, node.links = node.length, 1
        up = node.parent
        if up is not None:
            up.length += node.length
            up.linked += node.linked
            up.links += node.links
            up.commas += node.commas
            if node.tag in BLOCK:
                up.blocks = True
            else:
                up.own += node.own
                up.blocks |= node.blocks


PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split())
BY_TAG = {"article": 25, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "th": -5} | dict.fromkeys(HEADINGS, -5)
SHORT = 25


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def score(nodes: list[Node]) -> Node | None:
    """Pass paragraphs' points upwards; the best container."""
    touched: dict[int, Node] = {}
    for node in nodes[1:]:
        if node.gone or node.tag not in BLOCK or node.length < SHORT or node.tag in HEADINGS:
            continue
        if node.tag in PARAGRAPHS and not node.blocks:
            points, level, up = 1.0 + node.commas + min(node.length // 100, 3), 1, node.parent
        elif node.own >= SHORT:  # text that stands in a container itself
            points, level, up = 1.0 + node.commas * node.own / node.length + min(node.own // 100, 3), 1, node
        else:
            continue
        if up is not None and up.tag not in BLOCK:
            up = up.block
        while up is not None and up.parent is not None and level <= 5:
            touched[id(up)] = up
            up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            up, level = up.block, level + 1
    best, found = float("-inf"), None
    for node in nodes:
        if id(node) in touched:
            own = (node.points + BY_TAG.get(node.tag, 0) + node.weight) * (1 - density(node))
            node.points = own
            if own > best:
                best, found = own, node
    return found


def around(best: Node) -> Node:
    """The article element around the best container, else the main element, if it has a fifth of the points; else the container."""
    found: dict[str, Node] = {}
    up = best
    while up is not None:
        if up.tag in CORE:
            found.setdefault(up.tag, up)
        up = up.parent
    for tag in CORE:
        if tag in found and found[tag].points >= LEAST * best.points and density(found[tag]) < 0.5:
            return found[tag]
    return best


def kept_parts(best: Node) -> list[Node | str]:
    """The container and those of its siblings that hold text of its kind, in page order; of a whole page, all that holds text.

    What lies between two kept parts is kept as well: raw text, inline elements, short blocks, and a list of
    links between two parts of running text.
    """
    if best.tag == "main":
        return [best]
    whole = best.tag in ("body", "html") or best.parent is None
    row = best.parts if whole else best.parent.parts
    least = max(10.0, best.points * LEAST)

    def sure(x: Node | str) -> bool:
        if isinstance(x, str):
            return bool(x.strip()) if whole else len(x.strip()) >= SHORT
        if x.gone or x is best:
            return not x.gone
        if whole:
            return not _link_list(x) and x.length > 0
        text = x.length >= SHORT and density(x) < 0.25 and (x.tag in BLOCK or not x.links)
        return (x.points >= least and density(x) < 0.5) or text or (x.tag in HEADINGS and x.length > 0)

    kept = [sure(x) for x in row]
    places = [i for i, k in enumerate(kept) if k]
    if not places:
        return []
    # the kept part before and after each place
    before, after, last = [], [0] * len(row), -1
    for i, k in enumerate(kept):
        before.append(last)
        last = i if k else last
    last = -1
    for i in range(len(row) - 1, -1, -1):
        after[i] = last
        last = i if kept[i] else last
    out: list[Node | str] = []
    for i, x in enumerate(row):
        if kept[i]:
            out.append(x)
        elif 0 <= before[i] and 0 <= after[i]:
            if isinstance(x, str) or x.gone:
                out.append(x)  # render() passes over what is gone
            elif _link_list(x):
                if _running(row[before[i]]) and _running(row[after[i]]):
                    out.append(x)
            elif x.tag not in BLOCK or density(x) < 0.5:
                out.append(x)
    return out


def _running(x: Node | str) -> bool:
    """Whether a part is running text."""
    if isinstance(x, str):
        return len(x.strip()) >= SHORT
    return x.tag not in HEADINGS and x.length >= SHORT and density(x) < 0.25


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links > 1 and density(node) > LINKS_ALLOWED


def render(parts: list[Node | str]) -> str:
    """Text of nodes in page order; blocks and line breaks separate words."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br" or x.tag == "hr":
            out.append(" ")
        elif not x.gone:
            if x.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    nodes = tree(source)
    prune(nodes)
    measure(nodes)
    if not nodes[0].length:
        nodes = tree(source)
        prune(nodes, by_name=False)
        measure(nodes)
    best = score(nodes)
    if best is not None:
        return render(kept_parts(around(best)))
    for tag in ("article", "main", "body"):
        for node in nodes:
            if node.tag == tag and not node.gone and node.length:
                return render([node])
    return render([nodes[0]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
