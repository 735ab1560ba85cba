"""Queries over pages and products derived from the tables, so that every rule and extractor has something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators import catalog as C
from siltstone.operators import products as P
from siltstone.operators import rules as R
from siltstone.plans.pages import H1S, HOST, HTML_BYTES, TITLE, WORDS
from siltstone.registry import query
from siltstone.sources.tables import dealt, table

#: What is put behind a page's title, by its number; in Spark's SQL.
HEAD = """concat(
 if(page_id % 2 = 0, concat('<meta name="description" content="', repeat('d', cast(40 + page_id % 150 as int)), '">'), ''),
 case page_id % 3 when 0 then concat('<link rel="canonical" href="', url, '">') when 1 then concat('<link rel="canonical" href="', url, 'x">') else '' end,
 if(page_id % 5 <> 0, '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta content="i.png" property="og:image">', '<meta property="og:title" content="t">'),
 if(page_id % 7 = 0, '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="t"><meta name="twitter:description" content="d">', ''),
 if(page_id % 11 = 0, '<meta name="robots" content="noindex, nofollow">', ''), if(page_id % 6 = 0, '<img src="a.png">', '<img src="a.png" alt="a">'))"""


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages with descriptions, canonical links, cards, directives and answers by their number."""
    own = table(spark, folder, "pages").withColumn("html", F.expr(f"replace(html, '</title>', concat('</title>', {HEAD}))"))
    status = F.expr("case when page_id % 17 = 0 then 503 when page_id % 13 = 0 then 404 else 200 end")
    return own.select("page_id", "url", "html", status.alias("status_code"), F.expr("if(page_id % 19 = 0, concat(url, '?r'), url)").alias("final_url"), F.expr("cast(page_id % 4 * 500 as int)").alias("response_ms"), U.host("url").alias("host"))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return R.page_issues(R.features(rich_pages(spark, folder)))


RICH = f"""WITH f AS (SELECT page_id, url, {HOST} AS host, {TITLE} AS title, {H1S} AS h1, {WORDS} AS words, {HTML_BYTES} AS bytes, CASE WHEN page_id % 17 = 0 THEN 503 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status,
 page_id % 19 = 0 AS moved, CASE WHEN page_id % 2 = 0 THEN 40 + page_id % 150 END AS described FROM pages),
i AS (SELECT *, list_filter([
 CASE WHEN title IS NULL THEN 'TITLE_MISSING' END, CASE WHEN title IS NOT NULL AND (length(title) < 20 OR length(title) > 65) THEN 'TITLE_LENGTH' END, CASE WHEN described IS NULL THEN 'DESCRIPTION_MISSING' END,
 CASE WHEN described < 70 OR described > 160 THEN 'DESCRIPTION_LENGTH' END, CASE WHEN page_id % 3 = 2 THEN 'CANONICAL_MISSING' END, CASE WHEN page_id % 3 = 1 OR (page_id % 3 = 0 AND moved) THEN 'CANONICAL_INCORRECT' END,
 CASE WHEN length(url) > 115 THEN 'URL_TOO_LONG' END, CASE WHEN status >= 500 THEN 'HTTP_5XX' END, CASE WHEN status BETWEEN 400 AND 499 THEN 'HTTP_4XX' END, CASE WHEN status < 400 AND moved THEN 'REDIRECT' END,
 CASE WHEN h1 = 0 THEN 'H1_MISSING' END, CASE WHEN h1 > 1 THEN 'H1_MULTIPLE' END, CASE WHEN page_id % 5 = 0 THEN 'OPEN_GRAPH_INCOMPLETE' END, CASE WHEN page_id % 7 <> 0 THEN 'TWITTER_CARD_INCOMPLETE' END,
 CASE WHEN page_id % 6 = 0 THEN 'IMAGES_WITHOUT_ALT' END, CASE WHEN page_id % 11 = 0 THEN 'NOINDEX' END, CASE WHEN page_id % 11 = 0 THEN 'NOFOLLOW' END, CASE WHEN words > 0 AND words < 250 THEN 'THIN_CONTENT' END,
 CASE WHEN page_id % 4 = 3 THEN 'SLOW_RESPONSE' END, CASE WHEN bytes > 799000 THEN 'HTML_TOO_LARGE' END], lambda x: x IS NOT NULL) AS codes FROM f),
l AS (SELECT page_id, url, host, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS place FROM i),
s AS (SELECT *, CASE WHEN code IN ('TITLE_MISSING', 'DESCRIPTION_MISSING', 'HTTP_5XX', 'HTTP_4XX') THEN 'critical' WHEN code IN ('TWITTER_CARD_INCOMPLETE', 'REDIRECT', 'NOINDEX', 'NOFOLLOW') THEN 'info' ELSE 'warning' END AS severity FROM l)
"""


@query(RICH + "SELECT url, place, code, severity FROM s")
def rich_issues_long(spark, folder):
    return R.issues_long(judged(spark, folder)).withColumn("place", F.col("place").cast("long"))


@query(RICH + "SELECT code, count(*) AS n, bool_or(severity = 'critical') AS critical FROM s WHERE severity <> 'info' GROUP BY code")
def rich_issue_counts(spark, folder):
    return R.issue_counts(R.issues_long(judged(spark, folder)))


@query(RICH + """, own AS (SELECT host, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM s GROUP BY host),
n AS (SELECT host, count(*) AS pages FROM i GROUP BY host),
d AS (SELECT host, count(*) AS copies FROM (SELECT host, title FROM i WHERE title IS NOT NULL GROUP BY host, title HAVING count(DISTINCT url) > 1 UNION ALL SELECT host, described::VARCHAR FROM i WHERE described IS NOT NULL GROUP BY host, described HAVING count(DISTINCT url) > 1) GROUP BY host),
j AS (SELECT host, pages, coalesce(critical, 0) AS critical, coalesce(warning, 0) + coalesce(copies, 0) AS warning, coalesce(info, 0) AS info FROM n LEFT JOIN own USING (host) LEFT JOIN d USING (host))
SELECT host, pages, critical, warning, info, 8 * critical + 3 * warning + info AS penalty, greatest(least(100 - (8 * critical + 3 * warning + info), 100), 0) AS score FROM j""")
def rich_site_score(spark, folder):
    return R.site_scores(judged(spark, folder), "host")


@query(RICH + """SELECT host, count(*) AS pages, count(*) FILTER (status < 400) AS valid, count(*) FILTER (status >= 400) AS broken, count(*) FILTER (moved) AS redirects, count(*) FILTER (title IS NULL) AS without_title,
 count(*) FILTER (described IS NULL) AS without_description, count(*) FILTER (page_id % 11 = 0) AS noindex, count(*) FILTER (words > 0 AND words < 250) AS thin FROM i GROUP BY host""")
def rich_site_summary(spark, folder):
    return R.summary(judged(spark, folder), "host").drop("broken_links")


@query(RICH + """SELECT url, CASE WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' ELSE 'ok' END AS status_class,
 CASE WHEN status >= 400 THEN 'error' WHEN page_id % 11 = 0 THEN 'noindex' ELSE 'indexable' END AS indexability FROM i""")
def page_indexability(spark, folder):
    return judged(spark, folder).select("url", R.status_class("status_code").alias("status_class"), R.indexability("status_code", "noindex").alias("indexability"))


def shop_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each part: structured data, a card, and for each third one a theme's data with two variants."""
    themed = """concat('<script type="application/json">{"title":"', p_name, '","vendor":"', p_brand, '","price":', p_size, ',"variants":[{"sku":"v', p_partkey, 'a","color":"red"},{"sku":"v', p_partkey, 'b","available":false}]}</script>')"""
    html = f"""concat('<html><head><title>', p_name, '</title><meta property="og:type" content="product"><meta property="og:title" content="', p_name, '"><script type="application/ld+json">{{"@graph":[{{"@type":"Product","sku":"', p_partkey,
     '","name":"', p_name, '","brand":{{"name":"', p_brand, '"}},"offers":{{"price":"', p_size, '","priceCurrency":"EUR"}},"image":["/i/', p_partkey, '.png","b.png"]}}]}}</script>', if(p_partkey % 3 = 0, {themed}, ''), '</head><body><h2>x</h2></body></html>')"""
    own = dealt(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    return own.select(F.concat(F.lit("s"), F.col("p_partkey") % 10).alias("site"), F.col("p_partkey").alias("place"), F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey")).alias("url"), F.expr(html).alias("html"))


SHOP = """WITH x AS (SELECT 's' || (p_partkey % 10) AS site, p_partkey AS k, p_name AS name, p_brand AS brand, p_size::VARCHAR AS price FROM part),
r AS (SELECT site, k, 'jsonLd' AS source, name, k::VARCHAR AS sku, brand, price, 'EUR' AS currency, 2 AS n_images, 0 AS n_variants FROM x
 UNION ALL SELECT site, k, 'openGraph', name, NULL, NULL, NULL, NULL, 0, 0 FROM x UNION ALL SELECT site, k, 'inline', name, NULL, brand, price, NULL, 0, 2 FROM x WHERE k % 3 = 0)
"""


@query(SHOP + "SELECT site, 'https://shop.example/p/' || k AS url, k::VARCHAR AS slug, source, name, sku, brand, price, currency, n_images, n_variants FROM r")
def product_records(spark, folder):
    own = P.extract(shop_pages(spark, folder))
    return own.select("site", "url", "slug", F.get("discovery_sources", 0).alias("source"), "name", "sku", "brand", "price", "currency", F.size("images").alias("n_images"), F.size("variants").alias("n_variants"))


@query(SHOP + "SELECT site, count(*) FILTER (source = 'jsonLd') AS \"jsonLd\", 0::BIGINT AS rdfa, 0::BIGINT AS embedded, 0::BIGINT AS magento, 0::BIGINT AS microdata, count(*) FILTER (source = 'openGraph') AS \"openGraph\", count(*) FILTER (source = 'inline') AS inline, 0::BIGINT AS html FROM r GROUP BY site")
def product_source_counts(spark, folder):
    return P.source_counts(P.extract(shop_pages(spark, folder)), "site")


@query(SHOP + "SELECT site, name, k::VARCHAR AS sku, brand, price, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS merged, CASE WHEN k % 3 = 0 THEN 'jsonLd,openGraph,inline' ELSE 'jsonLd,openGraph' END AS sources, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS n_variants FROM x")
def product_merged(spark, folder):
    own = C.merge(P.extract(shop_pages(spark, folder)))
    return own.select("site", "name", "sku", "brand", "price", "merged", F.array_join("discovery_sources", ",").alias("sources"), F.size("variants").alias("n_variants"))


@query(SHOP + "SELECT site, k, unnest([0, 1]) AS place, unnest(['https://shop.example/i/' || k || '.png', 'https://shop.example/p/b.png']) AS url, unnest(['featured', 'gallery']) AS role, unnest([k || '.png', 'b.png']) AS filename, 'image/png' AS mime_type FROM x")
def product_media(spark, folder):
    own = P.media(P.extract(shop_pages(spark, folder)))
    width = len(P.EXTRACTORS) * P.MOST
    return own.select("site", F.expr(f"seq div {width}").alias("k"), F.col("order").alias("place"), "url", "role", "filename", "mime_type")
