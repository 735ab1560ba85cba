"""Products found in pages: several extractors over parsed pages, united in a fixed order.

Structured data is found by one small walk over the JSON of a page; all other
extractors are expressions over the node list of ``dom.parsed``.  Rows have
the columns of ``catalog.PRODUCT``; ``seq`` orders them by page, extractor and
position, which ``catalog.merge`` needs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.functions.text import mime_type, slug
from siltstone.operators import catalog as C
from siltstone.operators import dom

EXTRACTORS = ("jsonLd", "rdfa", "embedded", "magento", "microdata", "openGraph", "inline", "html")
#: Room for the products of one extractor on one page in ``seq``.
MOST = 10_000_000
DOCUMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "zip")
JSON_PRODUCT = "struct<sku: string, gtin: string, mpn: string, name: string, url: string, price: string, regular_price: string, sale_price: string, currency: string, availability: string, description: string, brand: string, images: array<string>, categories: array<string>, tags: array<string>, variants: array<" + C.VARIANT + ">>"


def _text(x: object) -> str | None:
    """A scalar as text; of an object its name, text or value."""
    if isinstance(x, dict):
        return next((t for k in ("name", "text", "value", "url", "@id") if (t := _text(x.get(k)))), None)
    if isinstance(x, list):
        return _text(x[0]) if x else None
    return None if x is None or isinstance(x, bool) or not str(x).strip() else str(x).strip()


def _list(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _is(x: dict, *kinds: str) -> bool:
    return any(isinstance(t, str) and t.lower().rsplit("/", 1)[-1] in kinds for t in _list(x.get("@type")))


def walk(value: object) -> Iterator[dict]:
    """Products depth first; what lies inside one is not looked at again."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            if _is(x, "product", "productgroup"):
                yield x
            else:
                stack.extend(reversed(list(x.values())))


def _offer(x: dict) -> dict:
    return next((o for o in _list(x.get("offers")) if isinstance(o, dict)), {})


def _product(x: dict) -> dict:
    offer = _offer(x)
    images = [t for i in _list(x.get("image")) if (t := _text(i.get("url") or i.get("contentUrl")) if isinstance(i, dict) else _text(i))]
    variants = []
    for v in _list(x.get("hasVariant") or x.get("model")):
        if isinstance(v, dict):
            o = _offer(v)
            named = {str(p.get("name")): _text(p.get("value")) for p in _list(v.get("additionalProperty")) if isinstance(p, dict) and p.get("name")}
            named |= {k: t for k in ("color", "size", "material") if (t := _text(v.get(k)))}
            variants.append({"id": _text(v.get("@id")), "sku": _text(v.get("sku")), "price": _text(o.get("price") or v.get("price")), "sale_price": None, "stock_status": _text(o.get("availability")), "image": _text(v.get("image")), "attributes": {k: v for k, v in named.items() if v}})
    return {
        "sku": _text(x.get("sku")), "gtin": next((t for k in ("gtin13", "gtin", "gtin14", "gtin12", "gtin8") if (t := _text(x.get(k)))), None), "mpn": _text(x.get("mpn")), "name": _text(x.get("name")), "url": _text(x.get("url")),
        "price": _text(offer.get("price") or offer.get("lowPrice") or x.get("price")), "regular_price": None, "sale_price": _text(offer.get("salePrice")), "currency": _text(offer.get("priceCurrency")), "availability": _text(offer.get("availability")),
        "description": _text(x.get("description")), "brand": _text(x.get("brand")), "images": images, "categories": [t for c in _list(x.get("category")) if (t := _text(c))], "tags": [t for c in _list(x.get("keywords")) if (t := _text(c))], "variants": variants,
    }


# Names under which a theme's variant tells its options.
OPTIONS = ("option1", "option2", "option3", "color", "colour", "size", "material", "pattern")


def _addresses(x: object) -> list[str]:
    """Addresses of images, given as texts or as objects."""
    out = []
    for i in _list(x):
        if isinstance(i, dict):
            i = next((i[k] for k in ("url", "src", "contentUrl", "image") if i.get(k)), None)
        if isinstance(i, str) and i.strip():
            out.append(i.strip())
    return out


def _themed(x: dict) -> dict:
    """A product as shop themes write it into a page: title, variants and images, without a type."""
    first = lambda o, *names: next((t for n in names if (t := _text(o.get(n))) is not None), None)
    own = [v for v in _list(x.get("variants")) if isinstance(v, dict)]
    variants = [
        {
            "id": _text(v.get("id")), "sku": _text(v.get("sku")), "price": _text(v.get("price")), "sale_price": first(v, "sale_price", "salePrice"), "stock_status": "outofstock" if v.get("available") is False else None,
            "image": next(iter(_addresses(v.get("image")) or _addresses(v.get("featured_image"))), None), "attributes": {k.replace("colour", "color"): t for k in OPTIONS if (t := _text(v.get(k)))},
        }
        for v in own
    ]
    return {
        "sku": _text(x.get("sku")), "gtin": None, "mpn": None, "name": first(x, "title", "name"), "url": _text(x.get("url")), "price": _text(x.get("price")), "regular_price": first(x, "regular_price", "regularPrice"),
        "sale_price": first(x, "sale_price", "salePrice"), "currency": _text(x.get("currency")), "availability": None, "description": first(x, "description", "body_html"), "brand": first(x, "vendor", "brand"),
        "images": [*_addresses(x.get("images")), *_addresses(x.get("media")), *[i for v in own for i in _addresses(v.get("image"))]],
        "categories": [t for c in _list(x.get("product_type") or x.get("category")) if (t := _text(c))], "tags": [t for c in _list(x.get("tags")) if (t := _text(c))], "variants": variants,
    }


ASSIGNED = re.compile(r"[=(]\s*(?=[{\[])")
DECODER = json.JSONDecoder()


def values_in(text: str) -> Iterator[object]:
    """JSON values of a script: its whole text, or whatever stands after an equals sign or as an argument in it."""
    try:
        yield json.loads(text)
        return
    except (ValueError, RecursionError):
        pass
    at = 0
    while (m := ASSIGNED.search(text, at)) is not None:
        try:
            value, at = DECODER.raw_decode(text, m.end())
            yield value
        except (ValueError, RecursionError):
            at = m.end()


def _states_of(texts) -> list[dict]:
    """Products in the data that scripts assign: typed ones, and objects with variants, title and images."""
    out = []
    for text in texts if texts is not None else []:
        for value in values_in(text):
            out += [_product(x) for x in walk(value)]
            stack = [value]
            while stack:
                x = stack.pop()
                if isinstance(x, dict) and not _is(x, "product", "productgroup"):
                    if x is not value and x.get("variants") and x.get("title") and x.get("images"):
                        out.append(_themed(x))
                    else:
                        stack.extend(reversed(list(x.values())))
                elif isinstance(x, list):
                    stack.extend(reversed(x))
    return out


def _inline_of(texts) -> list[dict]:
    """Scripts that are one product themselves: an object without a type that has a title, variants or images."""
    out = []
    for text in texts if texts is not None else []:
        for x in values_in(text):
            if isinstance(x, dict) and "@type" not in x and "@graph" not in x:
                found = _themed(x)
                if found["name"] or found["variants"] or found["images"]:
                    out.append(found)
    return out


def _products_of(texts) -> list[dict]:
    """Products in a list of JSON texts; a text that does not parse has none."""
    out = []
    for text in texts if texts is not None else []:
        try:
            out += [_product(x) for x in walk(json.loads(text))]
        except (ValueError, RecursionError):
            continue
    return out


def json_products(scripts: Column, find=_products_of) -> Column:
    def of(column: pd.Series) -> pd.Series:
        return column.map(find)

    return F.pandas_udf(of, f"array<{JSON_PRODUCT}>")(scripts)


def _scripts() -> Column:
    """Texts of a page's own scripts, without JSON-LD; framework data islands are among them."""
    own = F.filter(dom.of_tag("script"), lambda n: (F.lower(F.coalesce(dom.attr(n, "type"), F.lit(""))) != "application/ld+json") & (dom.attr(n, "src").isNull() | (dom.attr(n, "type") == "application/json")))
    return F.filter(F.transform(own, lambda n: n["text"]), lambda t: t.rlike(r"[{\[]"))


def _mage_init() -> Column:
    return F.filter(F.transform(dom.NODES, lambda n: dom.attr(n, "data-mage-init")), lambda t: t.isNotNull())


def _html_variants() -> Column:
    """Variants that elements of the page tell by their data attributes."""
    own = F.filter(dom.NODES, lambda n: dom.attr(n, "data-variant-id").isNotNull() | dom.attr(n, "data-sku").isNotNull())
    names = ("color", "size", "material", "pattern")

    def variant(n: Column) -> Column:
        named = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[dom.attr(n, f"data-{k}") for k in names])), lambda _, v: v.isNotNull())
        data = lambda name: dom.attr(n, f"data-{name}")
        return F.struct(F.coalesce(data("variant-id"), data("sku")).alias("id"), data("sku").alias("sku"), data("price").alias("price"), data("sale-price").alias("sale_price"), data("stock-status").alias("stock_status"), data("image").alias("image"), named.alias("attributes"))

    return F.transform(own, variant).cast(f"array<{C.VARIANT}>")


def _row(source: str, **columns: Column) -> Column:
    """One product struct with the given columns."""
    lists = {c: F.array().cast("array<string>") for c in C.LISTS} | {"variants": F.array().cast(f"array<{C.VARIANT}>"), "discovery_sources": F.array(F.lit(source))}
    return F.struct(*[columns.get(c, F.lit(None).cast("string")).alias(c) for c in C.FIELDS], *[columns.get(c, lists[c]).alias(c) for c in (*C.LISTS, "variants")])


def _from_json(source: str, found: Column) -> Column:
    fields = ("sku", "gtin", "mpn", "name", "url", "price", "regular_price", "sale_price", "currency", "availability", "description", "brand", "images", "categories", "tags", "variants")
    return F.transform(found, lambda p: _row(source, **{c: p[c] for c in fields}))


def _properties(attribute: str, kind: Column) -> Column:
    """Items of a kind with the first value of each property, by the attribute that names properties."""
    value = lambda m: F.coalesce(dom.attr(m, "content"), dom.attr(m, "src"), dom.attr(m, "href"), dom.inner_text(m))

    def item(n: Column) -> Column:
        own = F.filter(dom.below(n), lambda m: dom.attr(m, attribute).isNotNull())
        first = lambda name: F.get(F.transform(F.filter(own, lambda m: F.regexp_replace(dom.attr(m, attribute), "^.*[:/]", "") == name), value), 0)
        images = F.filter(F.transform(F.filter(own, lambda m: F.regexp_replace(dom.attr(m, attribute), "^.*[:/]", "") == "image"), value), lambda v: v.isNotNull())
        return _row("rdfa" if attribute == "property" else "microdata", name=first("name"), sku=first("sku"), gtin=first("gtin13"), price=first("price"), currency=first("priceCurrency"), availability=first("availability"), description=first("description"), brand=first("brand"), url=first("url"), images=images)

    return F.transform(kind, item)


def _open_graph() -> Column:
    is_product = F.lower(F.coalesce(dom.meta("og:type"), F.lit(""))).contains("product") | dom.meta("product:price:amount", "og:price:amount").isNotNull()
    row = _row(
        "openGraph", name=dom.meta("og:title"), url=dom.meta("og:url"), price=dom.meta("product:price:amount", "og:price:amount"), currency=dom.meta("product:price:currency", "og:price:currency"), description=dom.meta("og:description"),
        brand=dom.meta("product:brand"), availability=dom.meta("product:availability"), sku=dom.meta("product:retailer_item_id"), images=F.array_compact(F.array(dom.meta("og:image"))),
    )
    return F.when(is_product, F.array(row)).otherwise(F.array().cast(row_type()))


def row_type() -> str:
    return "array<struct<" + ", ".join([*(f"{c}: string" for c in C.FIELDS), *(f"{c}: array<string>" for c in C.LISTS), f"variants: array<{C.VARIANT}>"]) + ">>"


def _html() -> Column:
    """A page that shows a product: a product root, or a price and something to buy it with."""
    named = lambda n: F.lower(F.concat_ws(" ", dom.attr(n, "class"), dom.attr(n, "id")))
    root = F.exists(dom.NODES, lambda n: named(n).rlike(r"(^|[\s_-])(product-(detail|page|single|main|info|summary)|single-product)\b"))
    prices = F.filter(dom.NODES, lambda n: named(n).rlike(r"(^|[\s_-])price\b") & dom.inner_text(n).rlike("[0-9]"))
    buys = F.exists(dom.NODES, lambda n: n["tag"].isin("button", "a", "input") & (F.concat_ws(" ", named(n), F.lower(dom.inner_text(n)), F.lower(dom.attr(n, "value"))).rlike(r"add-to-cart|add to cart|añadir al carrito|comprar|buy now")))
    price = F.regexp_extract(dom.inner_text(F.get(prices, 0)), r"([0-9]+(?:[.,][0-9]+)*)", 1)
    gallery = F.filter(dom.of_tag("img"), lambda n: named(n).rlike("gallery|product|zoom") | dom.attr(n, "data-zoom-image").isNotNull())
    row = _row("html", name=F.get(dom.headings(1), 0), price=F.nullif(price, F.lit("")), images=F.array_distinct(F.filter(F.transform(gallery, lambda n: F.coalesce(dom.attr(n, "data-src"), dom.attr(n, "src"))), lambda s: s.isNotNull())), variants=_html_variants())
    return F.when((root | ((F.size(prices) > 0) & buys)) & (F.size(dom.headings(1)) > 0), F.array(row)).otherwise(F.array().cast(row_type()))


def extract(pages: DataFrame) -> DataFrame:
    """All product records of pages (site, place, url, html) in order, addresses resolved, with slugs."""
    own = dom.parsed(pages.select("site", "place", "url", "html"))
    own = own.withColumn("_ld", json_products(dom.json_ld())).withColumn("_embedded", json_products(_scripts(), _states_of))
    own = own.withColumn("_magento", json_products(_mage_init())).withColumn("_inline", json_products(_scripts(), _inline_of))
    schema_item = lambda n, name: F.coalesce(dom.attr(n, name), F.lit("")).rlike(r"(?i)(^|[:/])product$")
    parts = {
        "jsonLd": _from_json("jsonLd", F.col("_ld")),
        "rdfa": _properties("property", F.filter(dom.NODES, lambda n: schema_item(n, "typeof"))),
        "embedded": _from_json("embedded", F.col("_embedded")),
        "magento": _from_json("magento", F.col("_magento")),
        "microdata": _properties("itemprop", F.filter(dom.NODES, lambda n: schema_item(n, "itemtype"))),
        "openGraph": _open_graph(),
        "inline": _from_json("inline", F.col("_inline")),
        "html": _html(),
    }
    every = F.flatten(F.array(*[_numbered(parts[k], n) for n, k in enumerate(EXTRACTORS)]))
    long = own.select("site", "place", "url", F.explode(every).alias("x"))
    seq = F.col("place").cast("long") * len(EXTRACTORS) * MOST + F.col("x.n")
    c = {name: F.col(f"x.p.{name}") for name in (*C.FIELDS, *C.LISTS, "variants")}
    c["url"] = F.coalesce(U.resolved(c["url"], F.col("url")), F.col("url"))
    base = F.col("url")
    c["images"] = F.transform(c["images"], lambda i: U.resolved(i, base))
    c["slug"] = F.coalesce(F.nullif(F.regexp_extract(U.trimmed_path(c["url"]), r"([^/]+)$", 1), F.lit("")), slug(F.coalesce(c["name"], F.lit("")), 80, "product"))
    return long.select("site", seq.alias("seq"), F.col("url").alias("source_url"), *[c[name].alias(name) for name in (*C.FIELDS, *C.LISTS, "variants")])


def _numbered(found: Column, extractor: int) -> Column:
    return F.transform(found.cast(row_type()), lambda p, i: F.struct((F.lit(extractor * MOST) + i).cast("long").alias("n"), p.alias("p")))


def source_counts(products: DataFrame, *by: str) -> DataFrame:
    """How many records each extractor gave."""
    own = products.select(*by, F.explode("discovery_sources").alias("source"))
    return own.groupBy(*by).agg(*[F.count_if(F.col("source") == s).alias(s) for s in EXTRACTORS])


def media(products: DataFrame) -> DataFrame:
    """One row for each image of a product in order; the first is the featured one."""
    own = products.select("site", "seq", F.posexplode(F.array_distinct("images")).alias("order", "url"))
    ext = U.extension("url")
    return own.withColumn("role", F.when(F.col("order") == 0, F.lit("featured")).otherwise(F.lit("gallery"))).withColumn("filename", F.regexp_extract(U.path("url"), r"([^/]+)$", 1)).withColumn("mime_type", mime_type(ext))


def downloads() -> Column:
    """Documents that a parsed page links to."""
    return F.array_distinct(F.filter(F.transform(dom.of_tag("a"), lambda n: dom.attr(n, "href")), lambda h: h.rlike(rf"(?i)\.({'|'.join(DOCUMENTS)})(\?|$)")))
