"""Pages as flat node lists.

One Arrow pass reads each page once and numbers its elements: ``id`` in
document order, ``last`` that of the last element inside, so that one element is inside another
if its id lies in (id, last] of that; ``first`` and ``stop`` bound its texts in the page's list
``node_texts``.  Everything else is column expressions over these, so nothing is shuffled and no
tree is built twice.  ``node_rows`` gives the same numbering as rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that an opening tag of a kind ends.
ENDED = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NODE = "struct<id: int, parent: int, last: int, depth: int, first: int, stop: int, tag: string, attrs: map<string, string>, text: string>"
#: Places among siblings as letters: 0 is "1", from 34 on "z".
PLACES = "123456789abcdefghijklmnopqrstuvwxyz"


class _Element:
    __slots__ = ("attrs", "children", "depth", "first", "last", "nth", "parent", "path", "stop", "tag", "texts")

    def __init__(self, parent: int, depth: int, tag: str, attrs: list[tuple[str, str]], first: int, nth: int, path: str) -> None:
        self.parent, self.depth, self.tag, self.attrs, self.first, self.nth, self.path = parent, depth, tag, attrs, first, nth, path
        self.children, self.texts, self.last, self.stop = 0, [], 0, 0


class Reader(HTMLParser):
    """Collects the elements of a page and its texts in their order; the root is element 0."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [_Element(-1, 0, "#root", [], 0, 0, "")]
        self.texts: list[str] = []
        self.open = [0]
        self.often: Counter[str] = Counter()

    def _end(self) -> None:
        own = self.elements[self.open.pop()]
        own.last, own.stop = len(self.elements) - 1, len(self.texts)
        self.often[own.tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended = ENDED.get(tag) or (("p",) if tag in ENDS_P else ())
        if ended and self.elements[self.open[-1]].tag in ended:
            self._end()
        above = self.elements[self.open[-1]]
        path = above.path + PLACES[min(above.children, len(PLACES) - 1)]
        self.elements.append(_Element(self.open[-1], len(self.open), tag, list({k: v or "" for k, v in reversed(attrs)}.items()), len(self.texts), above.children, path))
        above.children += 1
        self.open.append(len(self.elements) - 1)
        self.often[tag] += 1
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if self.often[tag] > 0:  # else there is nothing to search for
            while self.elements[self.open[-1]].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        self.elements[self.open[-1]].texts.append(len(self.texts))
        self.texts.append(data)

    def own_text(self, element: _Element) -> str:
        return "".join(self.texts[i] for i in element.texts)


def read(html: str | None) -> Reader:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader._end()
    return reader


def nodes_of(html: str | None) -> list[dict]:
    reader = read(html)
    return _listed(reader)


def _listed(reader: Reader) -> list[dict]:
    return [
        {"id": i, "parent": e.parent, "last": e.last, "depth": e.depth, "first": e.first, "stop": e.stop, "tag": e.tag, "attrs": e.attrs, "text": reader.own_text(e)}
        for i, e in enumerate(reader.elements)
    ]


#: Pages are handed on together until they have so many elements and characters of text.
NODES_AT_ONCE, CHARS_AT_ONCE = 4096, 1 << 20


def _columns(readers: list[Reader]) -> list[pa.Array]:
    """``nodes`` and ``node_texts`` of some pages as Arrow columns, made flat: no element is boxed by itself."""
    every = [e for reader in readers for e in reader.elements]
    ints = lambda values: pa.array(list(values), pa.int32())
    offsets = lambda sizes: pa.array([0, *accumulate(sizes)], pa.int32())
    pairs = [x for e in every for x in e.attrs]
    attrs = pa.MapArray.from_arrays(offsets(len(e.attrs) for e in every), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    numbers = [ints(i for reader in readers for i in range(len(reader.elements)))]
    numbers += [ints(getattr(e, name) for e in every) for name in ("parent", "last", "depth", "first", "stop")]
    tags, texts = pa.array([e.tag for e in every], pa.string()), pa.array([reader.own_text(e) for reader in readers for e in reader.elements], pa.string())
    rows = pa.StructArray.from_arrays([*numbers, tags, attrs, texts], ["id", "parent", "last", "depth", "first", "stop", "tag", "attrs", "text"])
    nodes = pa.ListArray.from_arrays(offsets(len(reader.elements) for reader in readers), rows)
    return [nodes, pa.ListArray.from_arrays(offsets(len(reader.texts) for reader in readers), pa.array([t for reader in readers for t in reader.texts], pa.string()))]


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``nodes`` and ``node_texts`` in place of the html column; a null page has only its root."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readers, elements, chars = [], 0, 0
            for r in range(batch.num_rows):
                source = batch.column(len(keep))[r].as_py()
                readers.append(read(source))
                elements, chars = elements + len(readers[-1].elements), chars + len(source or "")
                if elements >= NODES_AT_ONCE or chars >= CHARS_AT_ONCE or r + 1 == batch.num_rows:
                    first, n = r + 1 - len(readers), len(readers)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, n) for i in range(len(keep))), *_columns(readers)], [*keep, "nodes", "node_texts"])
                    readers, elements, chars = [], 0, 0

    kinds = dict(pages.dtypes)
    return pages.select(*keep, F.col(html).cast("string")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"nodes array<{NODE}>", "node_texts array<string>"]))


LEAD, LETTERS = 240, 80
_LETTER = re.compile("[A-Za-z0-9]")


def _lead(texts: list[str], first: int, stop: int) -> str:
    """The text of an element, white space collapsed; of a long one as much as has LEAD characters and LETTERS letters or digits."""
    most = 16
    while True:
        text = " ".join("".join(texts[first : min(stop, first + most)]).split())
        if first + most >= stop or (len(text) > LEAD and len(_LETTER.findall(text[:-1], 0)) >= LETTERS):
            return text
        most *= 4


def node_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each element of each page (not its root), with the other columns of ``pages``.

    ``node``, ``parent``, ``last`` and ``depth`` number it; ``nth`` is its place among the elements of
    its parent and ``path`` those places from the root on, a letter of PLACES each; ``lead`` is the start of
    its text; ``sources`` are the addresses of the images inside.
    """
    keep = [c for c in pages.columns if c != html]
    kinds = dict(pages.dtypes)
    names = ["node", "parent", "last", "depth", "nth", "children", "path", "parent_tag", "tag", "attrs", "lead", "sources"]
    told = "node int, parent int, last int, depth int, nth int, children int, path string, parent_tag string, tag string, attrs map<string, string>, lead string, sources array<string>"

    def columns(readers: list[Reader]) -> list[pa.Array]:
        every = [(reader, i, reader.elements[i]) for reader in readers for i in range(1, len(reader.elements))]
        ints, texts = lambda values: pa.array(list(values), pa.int32()), lambda values: pa.array(list(values), pa.string())
        offsets = lambda sizes: pa.array([0, *accumulate(sizes)], pa.int32())
        sources = []
        for reader in readers:
            images = [(i, own["src"]) for i, e in enumerate(reader.elements) if e.tag == "img" and "src" in (own := dict(e.attrs))]
            at, found = [i for i, _ in images], [s for _, s in images]
            sources += [found[bisect_right(at, i) : bisect_right(at, e.last)] for i, e in enumerate(reader.elements) if i]
        pairs = [x for _, _, e in every for x in e.attrs]
        return [
            ints(i for _, i, _ in every), *(ints(getattr(e, name) for _, _, e in every) for name in ("parent", "last", "depth", "nth", "children")), texts(e.path for _, _, e in every),
            texts(reader.elements[e.parent].tag for reader, _, e in every), texts(e.tag for _, _, e in every), pa.MapArray.from_arrays(offsets(len(e.attrs) for _, _, e in every), texts(k for k, _ in pairs), texts(v for _, v in pairs)),
            texts(_lead(reader.texts, e.first, e.stop) for reader, _, e in every), pa.ListArray.from_arrays(offsets(map(len, sources)), texts(x for s in sources for x in s)),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readers, elements = [], 0
            for r in range(batch.num_rows):
                readers.append(read(batch.column(len(keep))[r].as_py()))
                elements += len(readers[-1].elements) - 1
                if elements >= NODES_AT_ONCE or r + 1 == batch.num_rows:
                    first = r + 1 - len(readers)
                    same = pa.array([first + n for n, reader in enumerate(readers) for _ in range(len(reader.elements) - 1)], pa.int64())
                    whole = pa.RecordBatch.from_arrays([*(batch.column(i).take(same) for i in range(len(keep))), *columns(readers)], [*keep, *names])
                    yield from (whole.slice(a, NODES_AT_ONCE) for a in range(0, elements, NODES_AT_ONCE))
                    readers, elements = [], 0

    return pages.select(*keep, F.col(html).cast("string")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), told]))


NODES = "nodes"


def of_tag(*tags: str) -> Column:
    return F.filter(NODES, lambda n: n["tag"].isin(*tags))


def attr(node: Column, name: str) -> Column:
    """An attribute, null where missing or blank."""
    return F.nullif(F.trim(F.try_element_at(node["attrs"], F.lit(name))), F.lit(""))


def inner_text(node: Column) -> Column:
    """Text of a node and all below it in its order, white space collapsed."""
    own = F.slice("node_texts", node["first"] + 1, node["stop"] - node["first"])
    return F.nullif(F.trim(F.regexp_replace(F.array_join(own, ""), r"(?U)\s+", " ")), F.lit(""))


def below(node: Column, *tags: str) -> Column:
    """Descendants of a node with one of the tags, or any."""
    every = F.slice(NODES, node["id"] + 2, node["last"] - node["id"])
    return F.filter(every, lambda m: m["tag"].isin(*tags)) if tags else every


def inside(node: Column, *tags: str) -> Column:
    """Whether a node has an ancestor with one of the tags."""
    return F.exists(of_tag(*tags), lambda m: (m["id"] < node["id"]) & (node["id"] <= m["last"]))


def css() -> Column:
    """The CSS of a page: its style elements by lines, then its style attributes."""
    inline = F.filter(F.transform(NODES, lambda n: F.try_element_at(n["attrs"], F.lit("style"))), lambda x: x.isNotNull())
    return F.concat(F.array_join(F.transform(of_tag("style"), lambda n: n["text"]), "\n"), F.lit("\n"), F.array_join(inline, ";"))


def meta(*names: str) -> Column:
    """Content of the first meta element with one of the names or properties."""
    low = [n.lower() for n in names]
    found = F.filter(NODES, lambda n: (n["tag"] == "meta") & (F.lower(attr(n, "name")).isin(*low) | F.lower(attr(n, "property")).isin(*low)))
    return F.get(F.transform(found, lambda n: attr(n, "content")), 0)


def headings(level: int) -> Column:
    return F.filter(F.transform(of_tag(f"h{level}"), inner_text), lambda t: t.isNotNull())


def open_graph() -> Column:
    return F.struct(*[meta(f"og:{n}").alias(n) for n in ("title", "description", "image", "type", "url")])


def twitter() -> Column:
    return F.struct(*[meta(f"twitter:{n}").alias(n) for n in ("card", "title", "description", "image")])


def canonical() -> Column:
    return F.get(F.transform(F.filter(of_tag("link"), lambda n: F.lower(attr(n, "rel")) == "canonical"), lambda n: attr(n, "href")), 0)


def anchors() -> Column:
    """href and text of each link."""
    return F.transform(F.filter(of_tag("a"), lambda n: attr(n, "href").isNotNull()), lambda n: F.struct(attr(n, "href").alias("href"), inner_text(n).alias("text")))


def images() -> Column:
    """src (lazy ones too), alt and size of each image; a size of 0 is none."""
    size = lambda n, c: F.nullif(attr(n, c).try_cast("int"), F.lit(0))
    return F.transform(
        of_tag("img"),
        lambda n: F.struct(F.coalesce(attr(n, "src"), attr(n, "data-src"), attr(n, "data-original")).alias("src"), attr(n, "alt").alias("alt"), size(n, "width").alias("width"), size(n, "height").alias("height")),
    )


def assets() -> Column:
    return F.struct(
        F.filter(F.transform(of_tag("script"), lambda n: attr(n, "src")), lambda x: x.isNotNull()).alias("scripts"),
        F.filter(F.transform(F.filter(of_tag("link"), lambda n: F.lower(attr(n, "rel")) == "stylesheet"), lambda n: attr(n, "href")), lambda x: x.isNotNull()).alias("stylesheets"),
        F.filter(F.transform(of_tag("img"), lambda n: attr(n, "src")), lambda x: x.isNotNull()).alias("images"),
    )


def json_ld() -> Column:
    """Texts of the JSON-LD scripts that parse."""
    scripts = F.filter(of_tag("script"), lambda n: F.lower(attr(n, "type")) == "application/ld+json")
    return F.filter(F.transform(scripts, lambda n: F.trim(n["text"])), lambda t: F.try_parse_json(t).isNotNull())


def microdata() -> Column:
    """Properties of each outermost item: its type, and name and value of all properties below it."""
    roots = F.filter(NODES, lambda n: F.map_contains_key(n["attrs"], "itemscope") & ~F.map_contains_key(n["attrs"], "itemprop"))
    value = lambda m: F.coalesce(attr(m, "content"), attr(m, "src"), attr(m, "href"), inner_text(m))
    props = lambda n: F.transform(F.filter(below(n), lambda m: attr(m, "itemprop").isNotNull()), lambda m: F.struct(attr(m, "itemprop").alias("name"), value(m).alias("value")))
    return F.transform(roots, lambda n: F.struct(attr(n, "itemtype").alias("type"), props(n).alias("properties")))


def forms() -> Column:
    """Action, method and fields of each form."""
    field = lambda m: F.struct(m["tag"].alias("tag"), F.coalesce(attr(m, "type"), F.lit("text")).alias("type"), attr(m, "name").alias("name"), F.map_contains_key(m["attrs"], "required").alias("required"))
    return F.transform(of_tag("form"), lambda n: F.struct(attr(n, "action").alias("action"), F.lower(F.coalesce(attr(n, "method"), F.lit("get"))).alias("method"), F.transform(below(n, "input", "select", "textarea"), field).alias("fields")))


def menus(limit: int = 80) -> Column:
    """Links of each navigation element, and where it stands."""
    place = lambda n: F.when(inside(n, "header"), F.lit("header")).when(inside(n, "footer"), F.lit("footer")).when(inside(n, "aside"), F.lit("sidebar")).otherwise(F.lit("main"))
    items = lambda n: F.slice(F.transform(F.filter(below(n, "a"), lambda m: attr(m, "href").isNotNull()), lambda m: F.struct(attr(m, "href").alias("href"), inner_text(m).alias("text"))), 1, limit)
    return F.transform(of_tag("nav"), lambda n: F.struct(place(n).alias("place"), items(n).alias("items")))


def part(tag: str) -> Column:
    """Facets of the first header or footer: text, logo, links, buttons, search and social links."""
    own = F.get(of_tag(tag), 0)
    social = r"(?i)(facebook|instagram|twitter|x|linkedin|youtube|tiktok|pinterest)\.com"
    return F.when(
        own.isNotNull(),
        F.struct(
            F.substring(inner_text(own), 1, 500).alias("text"),
            F.get(F.transform(F.filter(below(own, "img"), lambda m: F.concat_ws(" ", attr(m, "class"), attr(m, "alt"), attr(m, "src")).rlike("(?i)logo")), lambda m: attr(m, "src")), 0).alias("logo"),
            F.size(below(own, "a")).alias("links"),
            F.size(below(own, "button")).alias("buttons"),
            (F.size(F.filter(below(own, "input"), lambda m: F.lower(attr(m, "type")) == "search")) > 0).alias("search"),
            F.filter(F.transform(below(own, "a"), lambda m: attr(m, "href")), lambda h: h.rlike(social)).alias("social"),
        ),
    )


def header_facets() -> Column:
    """Facets of a page's header: what it offers, its calls to action, whether it sticks, its heights, the tags of its children; null without one."""
    said = lambda n: F.coalesce(attr(n, "class"), F.lit(""))
    own = F.get(F.filter(NODES, lambda n: (n["tag"] == "header") | (n["attrs"]["role"] == "banner") | _has_class(n, "site-header") | (n["attrs"]["id"] == "header")), 0)
    text, classes = F.lower(F.concat_ws(" ", inner_text(own), said(own))), F.lower(said(own))
    search = F.exists(below(own), lambda m: ((m["tag"] == "input") & (m["attrs"]["type"] == "search")) | _has_class(m, "search") | (m["attrs"]["role"] == "search"))
    calls = F.filter(F.transform(below(own, "a", "button"), inner_text), lambda t: t.isNotNull())
    height = F.nullif(F.regexp_extract(F.coalesce(own["attrs"]["style"], F.lit("")), r"(?i)height\s*:\s*([^;]+)", 1), F.lit(""))
    return F.when(
        own.isNotNull(),
        F.struct(
            search.alias("search"),
            text.rlike("cart|basket|bag|carrito|cesta").alias("cart"),
            text.rlike("wishlist|favorit").alias("wishlist"),
            text.rlike("login|account|my account|cuenta|acceder").alias("login"),
            F.slice(F.array_distinct(calls), 1, 10).alias("calls"),
            classes.rlike("sticky|fixed").alias("sticky"),
            classes.rlike("transparent").alias("transparent"),
            F.array_distinct(F.array_compact(F.array(own["attrs"]["height"], height))).alias("heights"),
            F.array_distinct(F.transform(F.filter(below(own), lambda m: m["parent"] == own["id"]), lambda m: m["tag"])).alias("layout"),
        ),
    )


def footer_facets() -> Column:
    """Facets of a page's footer: columns, copyright line, social links; null without one."""
    own = F.get(F.filter(NODES, lambda n: (n["tag"] == "footer") | (n["attrs"]["role"] == "contentinfo") | _has_class(n, "site-footer") | (n["attrs"]["id"] == "footer")), 0)
    column = lambda m: _has_class(m, "column", "widget") | F.contains(F.coalesce(attr(m, "class"), F.lit("")), F.lit("col-"))
    lines = F.filter(F.transform(below(own), inner_text), lambda t: t.rlike("(?i)©|copyright"))
    social = F.filter(F.transform(below(own, "a"), lambda m: m["attrs"]["href"]), lambda h: h.rlike(r"facebook|instagram|linkedin|twitter|x\.com|youtube"))
    return F.when(own.isNotNull(), F.struct(F.greatest(F.size(F.filter(below(own), column)), F.lit(1)).alias("columns"), F.get(lines, 0).alias("copyright"), social.alias("social")))


def _has_class(node: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.coalesce(attr(node, "class"), F.lit("")), r"\s+"), F.array(*[F.lit(n) for n in names])), F.lit(False))


def outermost(nodes: Column) -> Column:
    """Of nodes in document order those inside no other of them, in one pass."""
    none = F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{NODE}>").alias("kept"))
    step = lambda x, n: F.when(n["id"] > x["reach"], F.struct(n["last"].alias("reach"), F.concat(x["kept"], F.array(n)).alias("kept"))).otherwise(x)
    return F.aggregate(nodes, none, step, lambda x: x["kept"])


def sections(limit: int = 40) -> Column:
    """Outermost sections with their heading, text length and blocks; ``main`` holds others, and is one itself."""
    title = lambda n: F.get(F.filter(F.transform(below(n, "h1", "h2", "h3"), inner_text), lambda t: t.isNotNull()), 0)
    parts = outermost(of_tag("section", "article", "header", "footer", "aside"))
    roots = F.array_sort(F.concat(parts, F.filter(of_tag("main"), lambda n: ~inside(n, "section", "article", "aside", "header", "footer"))), lambda a, b: a["id"] - b["id"])
    return F.slice(F.transform(roots, lambda n: F.struct(n["tag"].alias("tag"), attr(n, "id").alias("anchor"), title(n).alias("title"), F.coalesce(F.length(inner_text(n)), F.lit(0)).alias("chars"), F.size(F.filter(below(n), lambda m: m["parent"] == n["id"])).alias("blocks"))), 1, limit)


def widgets(limit: int = 80) -> Column:
    """Embedded frames, players, maps and carousels by kind."""
    hint = lambda n: F.lower(F.concat_ws(" ", attr(n, "class"), attr(n, "id"), attr(n, "src")))
    kind = lambda n: (
        F.when(hint(n).rlike("youtube|vimeo|video"), F.lit("video")).when(hint(n).rlike("maps"), F.lit("map")).when(hint(n).rlike("slider|carousel|swiper"), F.lit("carousel"))
        .when(hint(n).rlike("accordion|faq"), F.lit("accordion")).when(hint(n).rlike("popup|modal"), F.lit("popup")).when(n["tag"] == "iframe", F.lit("frame"))
    )
    found = F.transform(F.filter(NODES, lambda n: n["tag"].isin("iframe", "video", "div", "section")), lambda n: F.struct(kind(n).alias("kind"), attr(n, "id").alias("anchor")))
    return F.slice(F.filter(found, lambda x: x["kind"].isNotNull()), 1, limit)


def features(pages: DataFrame) -> DataFrame:
    """The whole row of a parsed page; pin it before use in several queries, as the pass runs Python."""
    own = parsed(pages)
    keep = [c for c in own.columns if c not in (NODES, "node_texts")]
    return own.select(
        *keep,
        F.get(F.transform(of_tag("title"), inner_text), 0).alias("title"),
        meta("description").alias("description"),
        meta("robots").alias("robots"),
        canonical().alias("canonical"),
        *[headings(i).alias(f"h{i}") for i in (1, 2, 3)],
        anchors().alias("anchors"),
        images().alias("images"),
        assets().alias("assets"),
        open_graph().alias("open_graph"),
        twitter().alias("twitter"),
        json_ld().alias("json_ld"),
        microdata().alias("microdata"),
        forms().alias("forms"),
        menus().alias("menus"),
        part("header").alias("header"),
        part("footer").alias("footer"),
        header_facets().alias("header_facets"),
        footer_facets().alias("footer_facets"),
        sections().alias("sections"),
        widgets().alias("widgets"),
    )
