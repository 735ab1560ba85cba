"""Page-quality rules as data, and what is summed from the issues they raise.

The rules are an ordered list of conditions over a table of page features.
Applied to a row they give an array of issues in the same order, so one scan
and no shuffle finds all page issues.  Duplicate titles and descriptions are
the only rules over several pages; they group by the value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import html as H
from siltstone.functions import urls as U
from siltstone.functions.text import utf16_length

WEIGHTS = {"critical": 8, "warning": 3, "info": 1}
FEATURES = {
    "final_url": "string", "status_code": "int", "title": "string", "description": "string", "canonical": "string", "h1_count": "int", "words": "int", "html_bytes": "long", "response_ms": "int",
    "og_title": "string", "og_description": "string", "og_image": "string", "twitter_card": "string", "twitter_title": "string", "twitter_description": "string",
    "images_without_alt": "int", "heavy_images": "int", "broken_links": "int", "noindex": "boolean", "nofollow": "boolean",
}


@dataclass(frozen=True)
class Limits:
    """What the rules compare with."""

    title: tuple[int, int] = (20, 65)
    description: tuple[int, int] = (70, 160)
    url: int = 115
    words: int = 250
    response_ms: int = 1200
    html_bytes: int = 800_000
    image_bytes: int = 300_000


def rules(limits: Limits = Limits()) -> list[tuple[str, str, Column]]:
    """Code, severity and condition of each rule, in the order in which issues are told."""
    c = F.col
    outside = lambda name, span: (utf16_length(name) < span[0]) | (utf16_length(name) > span[1])
    final, status = F.coalesce("final_url", "url"), F.coalesce("status_code", F.lit(200))
    wrong = (c("canonical") != final) | (U.origin("canonical") != U.origin(final))
    missing = lambda *names: F.greatest(*[c(n).isNull() for n in names])
    return [
        ("TITLE_MISSING", "critical", c("title").isNull()),
        ("TITLE_LENGTH", "warning", outside("title", limits.title)),
        ("DESCRIPTION_MISSING", "critical", c("description").isNull()),
        ("DESCRIPTION_LENGTH", "warning", outside("description", limits.description)),
        ("CANONICAL_MISSING", "warning", c("canonical").isNull()),
        ("CANONICAL_INCORRECT", "warning", wrong),
        ("URL_TOO_LONG", "warning", utf16_length("url") > limits.url),
        ("HTTP_5XX", "critical", status >= 500),
        ("HTTP_4XX", "critical", status.between(400, 499)),
        ("REDIRECT", "info", (status < 400) & ((status >= 300) | (final != c("url")))),
        ("H1_MISSING", "warning", c("h1_count") == 0),
        ("H1_MULTIPLE", "warning", c("h1_count") > 1),
        ("OPEN_GRAPH_INCOMPLETE", "warning", missing("og_title", "og_description", "og_image")),
        ("TWITTER_CARD_INCOMPLETE", "info", missing("twitter_card", "twitter_title", "twitter_description")),
        ("IMAGES_WITHOUT_ALT", "warning", c("images_without_alt") > 0),
        ("HEAVY_IMAGES", "warning", c("heavy_images") > 0),
        ("BROKEN_LINKS", "critical", c("broken_links") > 0),
        ("NOINDEX", "info", c("noindex")),
        ("NOFOLLOW", "info", c("nofollow")),
        ("THIN_CONTENT", "warning", (c("words") > 0) & (c("words") < limits.words)),
        ("SLOW_RESPONSE", "warning", c("response_ms") > limits.response_ms),
        ("HTML_TOO_LARGE", "warning", c("html_bytes") > limits.html_bytes),
    ]


def features(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Features of raw pages (url, html, and where there are final_url, status_code, response_ms, broken_links); html is dropped."""
    has = set(pages.columns)
    given = lambda name, kind: (F.col(name) if name in has else F.lit(None)).cast(kind).alias(name)
    robots = H.meta("html", "robots")
    image = r"(?is)<img\b[^>]*>"
    images = F.regexp_extract_all("html", F.lit(image), 0)
    inline = F.transform(images, lambda x: F.regexp_extract(x, r"""(?i)src\s*=\s*["'](data:image/[^"']*)["']""", 1))
    keep = [c for c in pages.columns if c not in FEATURES and c != "html"]
    return pages.select(
        *keep,
        given("final_url", "string"),
        given("status_code", "int"),
        H.title("html").alias("title"),
        H.meta("html", "description").alias("description"),
        H.canonical_href("html").alias("canonical"),
        F.size(H.headings("html", 1)).alias("h1_count"),
        H.word_count(H.body_text("html")).alias("words"),
        F.octet_length("html").cast("long").alias("html_bytes"),
        given("response_ms", "int"),
        *[H.meta("html", f"{kind}:{name}").alias(f"{alias}_{name}") for kind, alias, names in (("og", "og", ("title", "description", "image")), ("twitter", "twitter", ("card", "title", "description"))) for name in names],
        F.size(F.filter(images, lambda x: ~x.rlike(r"""(?is)\salt\s*=\s*["'][^"']*\S[^"']*["']"""))).alias("images_without_alt"),
        F.size(F.filter(inline, lambda x: F.octet_length(x) > limits.image_bytes)).alias("heavy_images"),
        given("broken_links", "int"),
        H.has_directive(robots, "noindex").alias("noindex"),
        H.has_directive(robots, "nofollow").alias("nofollow"),
    )


def page_issues(featured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``featured`` with ``issues``, an array of (code, severity) in the order of the rules."""
    told = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in rules(limits)]
    return featured.withColumn("issues", F.array_compact(F.array(*told)))


def indexability(status: Column | str, noindex: Column | str) -> Column:
    s, n = (F.col(x) if isinstance(x, str) else x for x in (status, noindex))
    return F.when(s >= 400, F.lit("error")).when(n, F.lit("noindex")).otherwise(F.lit("indexable"))


def status_class(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s >= 500, F.lit("server_error")).when(s >= 400, F.lit("client_error")).when(s >= 300, F.lit("redirect")).otherwise(F.lit("ok"))


def duplicate_groups(pages: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Values that more than one URL has, with the sorted URLs."""
    found = pages.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.sort_array(F.collect_set("url")).alias("urls"))
    return found.where(F.size("urls") > 1)


def duplicate_issues(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One global issue for each group of pages with the same title or description."""
    parts = []
    for value, code in (("title", "DUPLICATE_TITLE"), ("description", "DUPLICATE_DESCRIPTION")):
        parts.append(duplicate_groups(pages, value, by).select(*(by or []), F.lit(code).alias("code"), F.lit("warning").alias("severity"), "urls"))
    return parts[0].unionByName(parts[1])


def issues_long(judged: DataFrame, *keep: str) -> DataFrame:
    """One row for each issue, with its place in the page's list."""
    # the outer form keeps the optimiser from testing the whole list of rules once more before it
    long = judged.select("url", *keep, F.posexplode_outer("issues").alias("place", "issue")).where("place is not null")
    return long.select("url", *keep, "place", "issue.code", "issue.severity")


def issue_counts(long: DataFrame, *by: str) -> DataFrame:
    """How often each code is told, and whether once critically; what is only informative is left out."""
    told = long.where(F.col("severity").isin("critical", "warning"))
    return told.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity") == "critical").alias("critical"))


def severity_counts(long: DataFrame, *by: str) -> DataFrame:
    return long.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])


def score(critical: Column, warning: Column, info: Column) -> tuple[Column, Column]:
    """A site's score from 0 to 100, and the penalty before it is cut."""
    penalty = critical * WEIGHTS["critical"] + warning * WEIGHTS["warning"] + info * WEIGHTS["info"]
    return F.greatest(F.least(100 - penalty, F.lit(100)), F.lit(0)), penalty


def sales_readiness(broken: Column, thin: Column, has_candidate: Column) -> Column:
    return F.greatest(F.least(100 - 8 * broken - 3 * thin - F.when(has_candidate, 8).otherwise(22), F.lit(100)), F.lit(0))


def site_scores(judged: DataFrame, site: str) -> DataFrame:
    """Pages, issues by severity, penalty and score of each site; global duplicate issues count too.

    One pass: each page gives a row of its issues, one of its title and one of
    its description; a title is a duplicate if its first and last address differ.
    """
    of = lambda severity: F.size(F.filter("issues", lambda x: x["severity"] == severity)).cast("long").alias(severity)
    row = lambda kind, value, *counts: F.struct(F.lit(kind).alias("kind"), value.alias("value"), *counts)
    none = [F.lit(0).cast("long").alias(s) for s in WEIGHTS]
    rows = F.array(row("page", F.lit(None).cast("string"), *[of(s) for s in WEIGHTS]), *[row(name, F.col(name), *none) for name in ("title", "description")])
    told = judged.select(site, "url", F.explode(rows).alias("x")).select(site, "url", "x.*").where("kind = 'page' or value is not null")
    held = told.groupBy(site, "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first"), F.max("url").alias("last"), *[F.sum(s).alias(s) for s in WEIGHTS])
    is_page = F.col("kind") == "page"
    total = held.groupBy(site).agg(F.sum(F.when(is_page, F.col("n")).otherwise(0)).alias("pages"), *[F.sum(s).alias(s) for s in WEIGHTS], F.count_if(~is_page & (F.col("first") != F.col("last"))).alias("copies"))
    joined = total.withColumn("warning", F.col("warning") + F.col("copies")).drop("copies")
    value, penalty = score(F.col("critical"), F.col("warning"), F.col("info"))
    return joined.withColumns({"penalty": penalty, "score": value})


def summary(judged: DataFrame, *by: str) -> DataFrame:
    """Totals of a crawl."""
    c = F.col
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.coalesce("status_code", F.lit(200)).between(200, 399)).alias("valid"),
        F.count_if(F.coalesce("status_code", F.lit(200)) >= 400).alias("broken"),
        F.count_if(F.coalesce("status_code", F.lit(200)).between(300, 399) | (F.coalesce("final_url", "url") != c("url"))).alias("redirects"),
        F.sum(F.coalesce("broken_links", F.lit(0))).alias("broken_links"),
        F.count_if(c("title").isNull()).alias("without_title"),
        F.count_if(c("description").isNull()).alias("without_description"),
        F.count_if(c("noindex")).alias("noindex"),
        F.count_if((c("words") > 0) & (c("words") < Limits().words)).alias("thin"),
    )


def top_codes(judged: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` codes of each page."""
    return judged.select("url", F.slice(F.transform("issues", lambda x: x["code"]), 1, n).alias("codes"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (page_url, target) to addresses whose page has a status of 400 or more.

    A page is known by its url and its final_url as they stand; where several
    pages have one address, the last in order (``place``) counts.
    """
    known = pages.select("place", "status_code", F.explode(F.array("url", F.coalesce("final_url", "url"))).alias("target"))
    known = known.groupBy("target").agg(F.max_by("status_code", "place").alias("status_code"))
    return links.join(known, "target").where(F.col("status_code") >= 400).select("page_url", "target", "status_code")


ISSUE = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("severity", T.StringType())]))


def with_empty_capture(scored: DataFrame, sites: DataFrame, site: str) -> DataFrame:
    """Scores of all ``sites``: one without a page gets 0 and two critical issues instead of a clean record."""
    none = F.col("pages").isNull()
    return sites.select(site).distinct().join(scored, site, "left").select(
        site, F.coalesce("pages", F.lit(0)).alias("pages"), F.when(none, 2).otherwise(F.col("critical")).alias("critical"), F.when(none, 0).otherwise(F.col("score")).alias("score"), F.when(none, F.lit("EMPTY_CAPTURE_EXPORT")).alias("reason")
    )
