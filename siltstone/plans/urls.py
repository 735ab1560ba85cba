"""URL queries over the pages' own addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as S
from siltstone.functions import urls as U
from siltstone.plans.pages import HOST, pages
from siltstone.registry import query

PATH = "CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
TRACKED = "(lower(regexp_replace(x, '=.*$', '')) LIKE 'utm\\_%' ESCAPE '\\' OR lower(regexp_replace(x, '=.*$', '')) IN ('fbclid', 'gclid', 'msclkid', '_ga', '_gl', 'ref', 'source', 'session', 'tracking', 'sid', 'sessionid', 'phpsessid', 'jsessionid', 'aspsessionid'))"
PARTS = f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?)', 1) AS scheme, {HOST} AS host, {PATH} AS path, list_filter(string_split({QUERY}, '&'), lambda x: x <> '') AS params FROM pages),
q AS (SELECT *, CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END AS trimmed, list_sort(list_filter(params, lambda x: NOT {TRACKED})) AS kept,
 list_filter(params, lambda x: lower(regexp_replace(x, '=.*$', '')) IN ('id', 'product_id', 'sku', 'slug', 'handle', 'item')) AS identity FROM p)
"""
JOINED = "scheme || '://' || host || CASE WHEN len({0}) > 0 THEN trimmed || '?' || array_to_string({0}, '&') WHEN trimmed = '/' THEN '' ELSE trimmed END"


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_counts(spark, folder):
    return pages(spark, folder).groupBy(U.host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(PARTS + f"SELECT page_id, {JOINED.format('kept')} AS canonical FROM q")
def url_canonical(spark, folder):
    return pages(spark, folder).select("page_id", U.canonical("url").alias("canonical"))


@query(PARTS + f"SELECT page_id, {JOINED.format('identity')} AS equivalence FROM q")
def url_equivalence_key(spark, folder):
    return pages(spark, folder).select("page_id", U.equivalence_key("url").alias("equivalence"))


PATTERN = """(CASE WHEN trimmed = '/' THEN '/' ELSE '/' || array_to_string(list_transform(list_filter(string_split(lower(trimmed), '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN ':id' ELSE x END), '/') || '/*' END)
 || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(list_transform(kept, lambda x: lower(regexp_replace(x, '=.*$', '')) || '=*')), '&') ELSE '' END"""


@query(PARTS + f"SELECT page_id, {PATTERN} AS pattern FROM q")
def url_pattern_key(spark, folder):
    return pages(spark, folder).select("page_id", U.pattern_key("url").alias("pattern"))


@query(
    PARTS
    + r""", k AS (SELECT page_id, CASE WHEN regexp_matches(lower(path), '(/product|/item|/shop|/store)/') THEN 'Product' WHEN regexp_matches(lower(path), '(/category|/cat)/') THEN 'Category'
 WHEN regexp_matches(lower(path), '(/collection|/coll)/') THEN 'Collection' WHEN regexp_matches(lower(path), '(/blog|/news)/') THEN 'Blog' WHEN regexp_matches(lower(path), '(/legal|/terms|/privacy)/') THEN 'Legal'
 WHEN regexp_matches(lower(path), '(/landing|/home)/') THEN 'LandingPage' WHEN len(list_filter(params, lambda x: lower(x) LIKE 'utm%' OR lower(x) LIKE 'ref=%' OR lower(x) LIKE 'source=%')) > 0 THEN 'Tracking' WHEN len(list_filter(params, lambda x: lower(x) LIKE 'page=%' OR lower(x) LIKE 'q=%' OR lower(x) LIKE 'sort=%')) > 0 THEN 'Functional' ELSE 'Static' END AS kind FROM q)
SELECT page_id, kind, CASE kind WHEN 'Product' THEN 100 WHEN 'Category' THEN 90 WHEN 'Collection' THEN 80 WHEN 'LandingPage' THEN 70 WHEN 'Blog' THEN 60 WHEN 'Legal' THEN 50 WHEN 'Functional' THEN 30 WHEN 'Static' THEN 20 ELSE 5 END AS priority FROM k"""
)
def url_category_priority(spark, folder):
    own = pages(spark, folder).select("page_id", U.kind("url").alias("kind"))
    return own.withColumn("priority", U.priority("kind"))


@query("WITH k AS (SELECT CASE WHEN regexp_matches(url, '[?&](utm_[a-z]*|ref|source)=') THEN 'Tracking' WHEN regexp_matches(url, '[?&](page|q|sort)=') THEN 'Functional' ELSE 'Static' END AS kind FROM pages) SELECT kind, count(*) AS n FROM k GROUP BY kind ORDER BY n DESC, kind LIMIT 10")
def url_category_histogram(spark, folder):
    own = pages(spark, folder).select(U.kind("url").alias("kind"))
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(10)


@query(PARTS + "SELECT page_id, lower(regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')) AS site FROM q")
def url_site_key(spark, folder):
    return pages(spark, folder).select("page_id", U.site_key("url").alias("site"))


@query(
    "WITH s AS (SELECT page_id, list_filter(string_split(" + PATH + """, '/'), lambda x: x <> '') AS parts FROM pages), e AS (SELECT unnest(range(1, len(parts))) AS i, parts FROM s)
SELECT DISTINCT '/' || array_to_string(list_slice(parts, 1, i), '/') AS ancestor FROM e"""
)
def ancestor_paths(spark, folder):
    return pages(spark, folder).select(F.explode(U.ancestors(U.path("url"))).alias("ancestor")).distinct()


@query("SELECT page_id, 'page:' || substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS id FROM pages")
def stable_id(spark, folder):
    return pages(spark, folder).select("page_id", S.stable_id("page", "url").alias("id"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS digest FROM pages")
def short_digest(spark, folder):
    return pages(spark, folder).select("page_id", S.short_digest("url").alias("digest"))


@query(
    """WITH RECURSIVE b AS (SELECT page_id, url FROM pages), f(page_id, url, i, h) AS (SELECT page_id, url, 1, 2166136261::UBIGINT FROM b
 UNION ALL SELECT page_id, url, i + 1, ((xor(h, unicode(substr(url, i, 1))::UBIGINT)::HUGEINT * 16777619) % 4294967296)::UBIGINT FROM f WHERE i <= length(url)),
d AS (SELECT page_id, h FROM f WHERE i = length(url) + 1),
t(page_id, h, s) AS (SELECT page_id, h, '' FROM d UNION ALL SELECT page_id, h // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (h % 36)::BIGINT + 1, 1) || s FROM t WHERE h > 0)
SELECT page_id, s AS id FROM t WHERE h = 0"""
)
def fnv_id(spark, folder):
    return pages(spark, folder).select("page_id", S.fnv1a("url").alias("id"))


@query(
    """WITH RECURSIVE f(page_id, url, i, h) AS (SELECT page_id, url, 1, 0::BIGINT FROM pages
 UNION ALL SELECT page_id, url, i + 1, ((h * 31 + ascii(substr(url, i, 1)) + 139586437120) % 4294967296) - 2147483648 FROM f WHERE i <= length(url)),
d AS (SELECT page_id, h FROM f WHERE i = length(url) + 1),
t(page_id, h, v, s) AS (SELECT page_id, h, abs(h), '' FROM d UNION ALL SELECT page_id, h, v // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', v % 36 + 1, 1) || s FROM t WHERE v > 0)
SELECT page_id, CASE WHEN h < 0 THEN '-' ELSE '' END || s AS id FROM t WHERE v = 0"""
)
def hash31(spark, folder):
    return pages(spark, folder).select("page_id", S.hash31("url").alias("id"))
