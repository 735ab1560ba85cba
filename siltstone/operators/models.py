"""Page models: all that is known of a page as one nested row, stored by version and site, and read back to tables.

``page_tables`` makes the tables of captured pages, ``nested`` gathers them to
one row for each page with a single shuffle, ``tables_of`` takes such rows apart
again, so tables to models to tables is the identity.  Models of older
versions are read with their own schema and brought to today's.  ``restored``
makes the tables that a deployment needs from models alone, without the pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.checkpoints import cut_together
from siltstone.functions import html as H
from siltstone.functions import text as S
from siltstone.functions import urls as U
from siltstone.operators import dom
from siltstone.operators import layout as L
from siltstone.operators import rules as R

VERSION = 3
HIDDEN, MENU = 200, 20
# What hides an element, in its opening tag.
HIDES = r"""(?is)<[^>]+(?:hidden|aria-hidden=["']true["']|style=["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)[^"']*["'])[^>]*>(.*?)</[^>]+>"""
ATTRIBUTE = r"""(?i)[a-z_:][-a-z0-9_:.]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""

#: The tables besides ``pages``: their columns after the page's address; the first ones order the rows of a page.
PARTS = {
    "headings": "level int, n int, text string",
    "links": "kind string, n int, url string",
    "images": "n int, src string, alt string, width int, height int",
    "issues": "n int, code string, severity string",
    "sections": "section int, section_id string, type string, tag string, columns long, elements long",
    "blocks": "section int, node int, level int, parent int, place string, block_id string, type string, tag string, text string, media array<string>",
    "components": "place int, component_id string, type string, provider string, tag string, classes string, items int, media array<string>",
    "forms": "form int, field int, form_id string, provider string, action string, method string, name string, label string, type string, required boolean, validation string",
    "widgets": "place int, widget_id string, type string, title string, text string, media array<string>",
}
PAGE = (
    "site string, place long, url string, slug string, source_url string, status_code int, depth int, title string, description string, canonical string, robots string, open_graph struct<title: string, description: string, image: string, type: string, url: string>,"
    " twitter struct<card: string, title: string, description: string, image: string>, json_ld array<string>, structured_types array<string>, visible_text string, hidden_text array<string>, head_html string, html_attributes map<string, string>, body_attributes map<string, string>, body_classes array<string>,"
    " indexability string, noindex boolean, nofollow boolean"
)
def schema() -> T.StructType:
    """Of a stored model: its version, PAGE, and a list for each of PARTS."""
    listed = lambda columns: ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))
    return T.StructType.fromDDL(f"version int, {PAGE}, " + ", ".join(f"{name} array<struct<{listed(columns)}>>" for name, columns in PARTS.items()))


def attributes_of(tag: Column) -> Column:
    """The attributes in an opening tag; of one that repeats, the last."""
    pairs = F.transform(F.reverse(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0)), lambda x: F.struct(F.trim(F.regexp_extract(x, "^[^=]*", 0)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, "(?s)^[^=]*=", "")), r"""(?s)^(["'])(.*)\1$""", "$2").alias("value")))
    keys = F.transform(pairs, lambda y: y["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def hidden_text(html: Column) -> Column:
    """Texts of elements that are not shown, the first HIDDEN."""
    plain = F.transform(F.regexp_extract_all(html, F.lit(HIDES), 1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))
    return F.slice(F.filter(plain, lambda x: x != ""), 1, HIDDEN)


def page_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """``pages`` and PARTS of captured pages (site, place, source_url, url: its final address, status_code, depth, html).

    Each page is read twice: once for its facts, once for its elements; both
    are kept in the shared folder by page, and every table is made from them.
    """
    html = F.coalesce("html", F.lit(""))
    tag = lambda name: F.regexp_extract(html, rf"(?i)<{name}\b([^>]*)>", 1)
    told = R.features(pages.select("site", "place", "depth", "source_url", F.col("url").alias("_url"), F.col("source_url").alias("url"), F.col("url").alias("final_url"), "status_code", html.alias("html"), html.alias("_html")))
    judged = R.page_issues(told).select("site", "place", "depth", "source_url", F.col("_url").alias("url"), "status_code", F.col("_html").alias("html"), "issues", "noindex", "nofollow")
    read = dom.parsed(judged.withColumn("_tags", F.array(tag("html"), tag("body"))).withColumn("_kept", html))
    kinds = F.transform(dom.json_ld(), lambda x: F.regexp_extract_all(x, F.lit(r'"@type"\s*:\s*"([^"]+)"'), 1))
    facts = cut_together(
        read.select(
            "site", "place", "url", "source_url", "status_code", "depth", "issues", "_tags", F.coalesce("noindex", F.lit(False)).alias("noindex"), F.coalesce("nofollow", F.lit(False)).alias("nofollow"), H.visible_text("_kept").alias("visible_text"),
            hidden_text(F.col("_kept")).alias("hidden_text"), F.regexp_extract("_kept", r"(?is)<head\b[^>]*>(.*?)</head>", 1).alias("head_html"), F.get(F.transform(dom.of_tag("title"), dom.inner_text), 0).alias("title"), dom.meta("description").alias("description"),
            dom.meta("robots").alias("robots"), dom.canonical().alias("canonical"), dom.open_graph().alias("open_graph"), dom.twitter().alias("twitter"), dom.json_ld().alias("json_ld"), kinds.alias("_kinds"),
            F.array(*[dom.headings(i) for i in range(1, 7)]).alias("_headings"), F.transform(dom.anchors(), lambda x: x["href"]).alias("_hrefs"), dom.images().alias("_images"),
        ),
        "url",
    )
    page = facts.select(
        "*", S.path_slug(U.path("url")).alias("slug"), R.indexability("status_code", "noindex").alias("indexability"), F.array_sort(F.array_distinct(F.flatten("_kinds"))).alias("structured_types"),
        attributes_of(F.col("_tags")[0]).alias("html_attributes"), attributes_of(F.col("_tags")[1]).alias("body_attributes"),
    ).withColumn("body_classes", F.filter(F.split(F.coalesce(F.col("body_attributes")["class"], F.lit("")), r"\s+"), lambda x: x != ""))
    heading = facts.select("url", F.posexplode("_headings").alias("level", "x")).select("url", F.posexplode("x").alias("n", "text"), (F.col("level") + 1).alias("level"))
    # an address that a page gives often is resolved once; of equal ones the first counts
    targets = F.array_distinct(F.filter(F.transform(F.array_distinct("_hrefs"), lambda x: U.resolved_href(x, F.col("url"))), lambda x: x.isNotNull()))
    link = facts.select("url", F.posexplode(targets).alias("n", "_to"))
    link = link.select("url", F.when(U.origin("_to") == U.origin("url"), F.lit("internal")).otherwise(F.lit("external")).alias("kind"), "n", "_to")
    image = facts.select("url", F.posexplode("_images").alias("n", "x")).select("url", "n", "x.*")
    issue = facts.select("url", F.posexplode("issues").alias("n", "x")).select("url", "n", "x.code", "x.severity")
    elements = cut_together(dom.node_rows(pages.select("url", "html")), "url", "node")
    sections = L.in_sections(elements)
    found = {"headings": heading, "links": link, "images": image, "issues": issue, "sections": L.sections(sections), "blocks": L.blocks(sections), "components": L.components(elements), "forms": L.forms(elements), "widgets": L.widgets(elements)}
    out = {"pages": page.select(*_cast(PAGE))}
    for name, columns in PARTS.items():
        renamed = found[name].withColumnsRenamed({"url": "page"}).withColumnsRenamed({"_to": "url"})
        out[name] = renamed.select("page", *_cast(columns))
    return out


def _cast(columns: str) -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(columns)]


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of schema() for each page of ``tables``, whose addresses are distinct; parts of no page are left out."""
    rows = [tables["pages"].select(F.col("url").alias("page"), F.struct(*[f.name for f in T.StructType.fromDDL(PAGE)]).alias("pages"))]
    rows += [tables[name].select("page", F.struct(*[f.name for f in T.StructType.fromDDL(columns)]).alias(name)) for name, columns in PARTS.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    lists = [F.array_sort(F.collect_list(name)).alias(name) for name in PARTS]
    own = every.groupBy("page").agg(F.collect_list("pages").alias("pages"), *lists).where(F.size("pages") > 0)
    own = own.select(F.explode("pages").alias("p"), *PARTS)
    return own.select(F.lit(VERSION).alias("version"), "p.*", *PARTS).select(*[F.col(f.name).cast(f.dataType) for f in schema()])


def tables_of(models: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``nested`` was given."""
    parts = {name: models.select(F.col("url").alias("page"), F.explode(name).alias("x")).select("page", *[F.col(f"x.{f.name}").alias(f.name) for f in T.StructType.fromDDL(columns)]) for name, columns in PARTS.items()}
    return {"pages": models.select(*[f.name for f in T.StructType.fromDDL(PAGE)])} | parts


def write_models(models: DataFrame, folder: str) -> None:
    """Models of today's version, a folder for each version and site."""
    models.drop("version").write.partitionBy("site").mode("append").parquet(f"{folder}/version={VERSION}")


#: Version 1 had links without kind and images by address alone, and no layout; version 2 had blocks of two levels inside their sections.
OLDER = {
    1: "site string, place long, url string, source_url string, status_code int, title string, description string, headings struct<h1: array<string>, h2: array<string>, h3: array<string>>, links array<string>, images array<string>, visible_text string",
    2: f"{PAGE}, " + ", ".join(f"{name} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in columns.split(', '))}>>" for name, columns in PARTS.items() if name not in ("sections", "blocks"))
    + ", layout array<struct<section: int, section_id: string, type: string, tag: string, columns: long, elements: long, node: int, blocks: array<struct<node: int, place: string, block_id: string, type: string, tag: string, text: string, media: array<string>,"
    " children: array<struct<node: int, place: string, block_id: string, type: string, tag: string, text: string, media: array<string>>>>>>>",
}


def _from_first(models: DataFrame) -> DataFrame:
    base = F.col("url")
    link = lambda x: F.when(U.origin(x) == U.origin(base), F.lit("internal")).otherwise(F.lit("external"))
    listed = lambda level: F.transform(F.coalesce(F.col(f"headings.h{level}"), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(level).alias("level"), i.alias("n"), x.alias("text")))
    links = F.transform("links", lambda x, i: F.struct(link(x).alias("kind"), i.alias("n"), x.alias("url")))  # in the order of the page
    return models.withColumns(
        {
            "headings": F.concat(*[listed(i) for i in (1, 2, 3)]), "links": F.array_sort(links), "slug": S.path_slug(U.path("url")),
            "images": F.transform("images", lambda x, i: F.struct(i.alias("n"), x.alias("src"), *[F.lit(None).alias(c) for c in ("alt", "width", "height")])),
        }
    )


def _from_second(models: DataFrame) -> DataFrame:
    names = [f.name for f in T.StructType.fromDDL(PARTS["blocks"])]

    def block(b: Column, section: Column, level: int, parent: Column) -> Column:
        made = {"section": section, "level": F.lit(level), "parent": parent}
        return F.struct(*[(made[n] if n in made else b[n]).alias(n) for n in names])

    each = lambda s: F.flatten(F.transform(s["blocks"], lambda b: F.concat(F.array(block(b, s["section"], 1, s["node"])), F.transform(b["children"], lambda c: block(c, s["section"], 2, b["node"])))))
    sections = F.transform("layout", lambda s: F.struct(*[s[f.name].alias(f.name) for f in T.StructType.fromDDL(PARTS["sections"])]))
    return models.withColumn("sections", sections).withColumn("blocks", F.array_sort(F.flatten(F.transform("layout", each)))).drop("layout")


def upgraded(models: DataFrame, version: int) -> DataFrame:
    """Models of some version as rows of schema(); what a version did not know is empty, or null."""
    own = {1: _from_first, 2: _from_second, VERSION: lambda m: m}[version](models)
    empty = {n: F.array().cast(schema()[n].dataType) for n in [*PARTS, "json_ld", "structured_types", "hidden_text", "body_classes"]}
    column = lambda f: (F.coalesce(F.col(f.name).cast(f.dataType), empty[f.name]) if f.name in empty else F.col(f.name).cast(f.dataType)) if f.name in own.columns else empty.get(f.name, F.lit(None).cast(f.dataType))
    return own.select(*[F.lit(version).alias("version") if f.name == "version" else column(f).alias(f.name) for f in schema()])


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """All models in ``folder``, whatever their version, as rows of schema(); a version that is not known is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    versions = sorted(int(name.split("=")[1]) for s in there if (name := s.getPath().getName()).startswith("version="))
    if unknown := [v for v in versions if v not in (*OLDER, VERSION)]:
        raise ValueError(f"page models of unknown versions {unknown}")
    if not versions:
        raise ValueError(f"no page models in {folder}")
    stored = {**{v: T.StructType.fromDDL(s) for v, s in OLDER.items()}, VERSION: T.StructType([f for f in schema() if f.name != "version"])}
    return reduce(DataFrame.unionByName, [upgraded(spark.read.schema(stored[v]).parquet(f"{folder}/version={v}"), v) for v in versions])


def restored(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a deployment needs of models: a row for each page, and the first MENU pages of each site as its menu."""
    of_kind = lambda kind: F.transform(F.filter("links", lambda x: x["kind"] == kind), lambda x: x["url"])
    level = lambda i: F.transform(F.filter("headings", lambda x: x["level"] == i), lambda x: x["text"])
    pages = models.select(
        "site", "place", "slug", F.coalesce("source_url", "url").alias("source_url"), F.coalesce("title", "slug").alias("title"), F.coalesce("description", F.lit("")).alias("meta_description"), F.coalesce("canonical", "url").alias("canonical"),
        *[level(i).alias(f"h{i}") for i in range(1, 7)], F.col("images"), of_kind("internal").alias("internal"), of_kind("external").alias("external"), F.lit("indexable").alias("indexability"), F.coalesce("robots", F.lit("")).alias("robots"),
        "structured_types", F.concat(F.lit("page:"), "slug").alias("model_ref"), F.filter(F.transform("images", lambda x: F.concat(F.lit("media:"), x["src"])), lambda x: x.isNotNull() & (x != "media:")).alias("media_refs"),
        "sections", "components", "forms", "widgets", F.coalesce("visible_text", F.lit("")).alias("content"), F.concat(F.lit("../../raw/pages/"), "slug", F.lit(".html")).alias("html_ref"),
    )
    n = F.row_number().over(Window.partitionBy("site").orderBy("place", "slug"))
    menus = pages.select("site", n.alias("n"), "title", "slug").where(F.col("n") <= MENU)
    return pages, menus
