"""Site models: what platforms a site shows, its parts, edges between pages and what they hold, and what to improve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as S
from siltstone.functions import urls as U

# Hosts of social profiles, and paths on them that are not profiles.
SOCIAL = {"facebook": r"(^|\.)facebook\.com$", "instagram": r"(^|\.)instagram\.com$", "twitter": r"(^|\.)(twitter|x)\.com$", "linkedin": r"(^|\.)linkedin\.com$", "youtube": r"(^|\.)youtube\.com$", "tiktok": r"(^|\.)tiktok\.com$", "pinterest": r"(^|\.)pinterest\.[a-z.]+$", "whatsapp": r"(^|\.)(wa\.me|whatsapp\.com)$"}
NO_PROFILE = r"(?i)/(share|sharer|intent|login|signup|dialog|plugins|hashtag|search|policies|privacy)"


def edges(pages: DataFrame) -> DataFrame:
    """Edges from pages (url, images, forms, widgets, product ids) to what they hold: source, target, type."""
    of = lambda column, kind: F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.struct(x.alias("target"), F.lit(kind).alias("type")))
    every = F.concat(of("media", "media"), of("components", "component"), of("forms", "form"), of("widgets", "widget"), of("products", "product"))
    return pages.select(F.col("url").alias("source"), F.explode(every).alias("x")).select("source", "x.target", "x.type").where("target is not null").distinct()


def facets(pages: DataFrame, values: str, limit: int) -> DataFrame:
    """Distinct values of a list column of each site in the order of their first use, at most ``limit``."""
    own = pages.select("site", "place", F.posexplode(values).alias("n", "value"))
    own = own.groupBy("site", "value").agg(F.min(F.struct("place", "n")).alias("at"))
    n = F.row_number().over(Window.partitionBy("site").orderBy("at"))
    return own.withColumn("n", n).where(F.col("n") <= limit).select("site", "n", "value")


def social_profiles(links: DataFrame, limit: int = 12) -> DataFrame:
    """Profiles that a site (site, place, url) links to: of one profile the place of its first link and the form of its last."""
    name = F.lit(None).cast("string")
    for platform, pattern in SOCIAL.items():
        name = F.coalesce(name, F.when(U.host("url").rlike(pattern), F.lit(platform)))
    own = links.withColumn("platform", name).where(F.col("platform").isNotNull() & ~U.path("url").rlike(NO_PROFILE) & (U.path("url") != "/"))
    own = own.withColumn("key", F.lower(F.concat("platform", F.lit(":"), U.origin("url"), U.trimmed_path("url"))))
    own = own.groupBy("site", "key").agg(F.first("platform").alias("platform"), F.min("place").alias("place"), F.max_by("url", "place").alias("url"))
    n = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    return own.withColumn("n", n).where(F.col("n") <= limit).select("site", "n", "platform", "url")


def page_type(url: Column | str) -> Column:
    at = F.lower(U.path(url))
    return F.when(at == "/", F.lit("home")).when(at.rlike(r"/(product|producto|item|p)s?/"), F.lit("product")).when(at.rlike(r"/(category|categoria|collection|coleccion|shop|tienda)"), F.lit("category")).otherwise(F.lit("content"))


def proposals(pages: DataFrame, brand: str = "title") -> DataFrame:
    """Safe changes for pages (url, title, description, h1, content, images): one row each, without those that change nothing."""
    plain = lambda c: F.coalesce(S.collapsed(c), F.lit(""))
    wanted_title = S.trimmed_to(F.coalesce(F.get("h1", 0), F.col("title"), F.lit("")), 60)
    bad_title = F.col("title").isNull() | ~S.utf16_length("title").between(20, 65)
    wanted_text = S.trimmed_to(F.coalesce(F.nullif(plain("content"), F.lit("")), F.get("h1", 0), F.col("title"), F.lit("")), 155)
    bad_text = F.col("description").isNull() | ~S.utf16_length("description").between(70, 160)
    change = lambda kind, target, before, after: F.struct(F.lit(kind).alias("kind"), target.alias("target"), F.coalesce(before, F.lit("")).alias("before"), after.alias("after"))
    alts = F.transform(F.filter("images", lambda i: i["alt"].isNull() & i["src"].isNotNull()), lambda i: change("image_alt", i["src"], F.lit(""), S.trimmed_to(F.coalesce(F.get("h1", 0), F.col("title"), F.lit("")), 120)))
    every = F.concat(F.array_compact(F.array(F.when(bad_title, change("title", F.lit("title"), F.col("title"), wanted_title)), F.when(bad_text, change("description", F.lit("meta[name=description]"), F.col("description"), wanted_text)))), alts)
    own = pages.select("url", page_type("url").alias("page_type"), F.explode(F.filter(every, lambda x: (x["after"] != "") & (x["after"] != x["before"]))).alias("x")).select("url", "page_type", "x.*")
    return own.withColumn("id", S.fnv1a(F.concat_ws("|", "url", "kind", "target", "after")))


def best_menu(menus: DataFrame, keep: int = 4, items: int = 50) -> DataFrame:
    """The menus (site, menu, semantic, labels) that navigate best: marked as such, with meaningful labels, about six of them, no page numbers."""
    words = F.size(F.filter("labels", lambda x: x.rlike(r"(?i)[a-zà-ÿ]{3,}")))
    numbers = F.size(F.filter("labels", lambda x: x.rlike(r"^\s*([0-9]+|«|»|<|>|next|prev)\s*$")))
    score = F.when(F.col("semantic"), 100).otherwise(0) + 10 * words - F.abs(F.size("labels") - 6) - F.when(numbers * 2 > F.size("labels"), 200).otherwise(0)
    n = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "menu"))
    return menus.withColumn("score", score).withColumn("labels", F.slice("labels", 1, items)).withColumn("n", n).where(F.col("n") <= keep)


def nearest_viewport(wanted: DataFrame, captures: DataFrame) -> DataFrame:
    """Of each wanted size (slug, w, h) the capture of the page whose size differs least; the earlier among equals."""
    own = wanted.join(captures.select("slug", F.col("w").alias("cw"), F.col("h").alias("ch"), "capture", "place"), "slug")
    gap = F.abs(F.col("w") - F.col("cw")) + F.abs(F.col("h") - F.col("ch"))
    return own.groupBy("slug", "w", "h").agg(F.min_by("capture", F.struct(gap, "place")).alias("capture"))


def component_strategy(kind: Column, fields: Column, dynamic: Column) -> Column:
    """How a part is rebuilt: dynamic parts by shortcode, forms as forms, simple ones as blocks, others as they are."""
    return F.when(dynamic, F.lit("shortcode")).when(kind == "form", F.lit("form")).when(kind.isin("heading", "text", "image", "button", "list"), F.lit("block")).when(fields > 0, F.lit("editable_html")).otherwise(F.lit("static_html"))


def fragment_consensus(fragments: DataFrame) -> DataFrame:
    """Of each site and locale the fragment that most pages share once addresses and numbers are masked; the longest form of it."""
    own = fragments.withColumn("key", S.masked_fragment("fragment"))
    groups = own.groupBy("site", "locale", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("fragment").alias("l"), F.col("fragment"))).alias("best"))
    return groups.groupBy("site", "locale").agg(F.max(F.struct("n", "best.l", "best.fragment")).alias("x")).select("site", "locale", F.col("x.n").alias("n"), F.col("x.fragment").alias("fragment"))


def capture_integrity(pages: DataFrame, captured: DataFrame) -> DataFrame:
    """Of each site how many declared pages have html, and whether all do."""
    own = pages.select("site", "slug").distinct().join(captured.where(F.length(F.trim("html")) > 0).select("site", "slug").distinct().withColumn("there", F.lit(1)), ["site", "slug"], "left")
    return own.groupBy("site").agg(F.count(F.lit(1)).alias("declared"), F.count("there").alias("captured")).withColumn("complete", F.col("declared") == F.col("captured"))
