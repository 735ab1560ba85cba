"""Frontier queries over the links of the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as S
from siltstone.functions import urls as U
from siltstone.operators import frontier as O
from siltstone.plans.pages import LINKS, links, pages
from siltstone.plans.urls import PARTS, PATTERN
from siltstone.registry import query
from siltstone.sources.tables import table

TARGETS = LINKS + ", t AS (SELECT page_id * 100000 + place AS seq, regexp_extract(url, '^https?://[^/?#]+') || href AS target FROM l)"
EXT = r"lower(regexp_extract(regexp_extract(regexp_extract(target, '^https?://[^/?#]+([^?#]*)', 1), '([^/]+)/?$', 1), '^.+\.([^.]*)$', 1))"


def candidates(spark, folder):
    return links(spark, folder).select((F.col("page_id") * 100_000 + F.col("place")).alias("seq"), F.col("target").alias("url"), F.col("url").alias("source_url"))


@query(TARGETS + f" SELECT seq, {EXT} AS extension, CASE WHEN {EXT} IN ('css') THEN 'stylesheet' WHEN {EXT} IN ('js', 'mjs', 'cjs', 'map') THEN 'script' WHEN {EXT} IN ('pdf', 'zip', 'doc', 'csv') THEN 'document' WHEN {EXT} IN ('jpg', 'png', 'gif', 'svg') THEN 'image' ELSE 'other' END AS asset_type FROM t")
def asset_links(spark, folder):
    return candidates(spark, folder).select("seq", F.coalesce(U.extension("url"), F.lit("")).alias("extension"), U.asset_type("url").alias("asset_type"))


#: Links here have no query or fragment, so their canonical form and equivalence key are one: the address itself.
ADMISSION = (
    TARGETS
    + """, u AS (SELECT seq, regexp_replace(target, '/$', '') AS url, min(seq) OVER (PARTITION BY regexp_replace(target, '/$', '')) AS first, lower(regexp_replace(regexp_replace(target, '/$', ''), '^https?://[^/?#]+', '')) AS path FROM t),
b AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE '/' || array_to_string(list_transform(string_split(substr(path, 2), '/'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN ':id' ELSE x END), '/') || '/*' END AS pattern FROM u),
c AS (SELECT *, sum(CASE WHEN seq = first THEN 1 ELSE 0 END) OVER (PARTITION BY pattern ORDER BY seq) AS n FROM b),
d AS (SELECT *, seq = first AND n <= 2 AS admitted FROM c),
e AS (SELECT *, min(CASE WHEN admitted THEN seq END) OVER (PARTITION BY url) AS taken FROM d)
SELECT seq, url, CASE WHEN taken < seq THEN 'duplicate' WHEN n - CASE WHEN seq = first THEN 1 ELSE 0 END >= 2 THEN 'pattern_cap' END AS reject_reason FROM e"""
)


@query(ADMISSION)
def frontier_admission(spark, folder):
    return O.admission(candidates(spark, folder), [], cap=2).select("seq", F.col("canonical").alias("url"), "reject_reason")


@query(PARTS + f", k AS (SELECT page_id, url, {PATTERN} AS pattern FROM q) SELECT page_id, pattern FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY page_id) AS n FROM k) WHERE n <= 2")
def pattern_cap(spark, folder):
    own = pages(spark, folder).select("page_id", U.pattern_key("url").alias("pattern"))
    return O.capped(own, "pattern", "page_id", 2)


@query("SELECT page_id, url, CASE WHEN regexp_matches(url, '[?&](utm_[a-z]*|ref|source)=') THEN 5 WHEN regexp_matches(url, '[?&](page|q|sort)=') THEN 30 ELSE 20 END AS priority FROM pages ORDER BY priority DESC, page_id LIMIT 50")
def frontier_topk(spark, folder):
    own = pages(spark, folder).select("page_id", "url")
    return O.prioritised(own, "page_id").select("page_id", "url", "priority").limit(50)


@query("WITH s AS (SELECT doc_id, source AS slug FROM documents) SELECT doc_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS n FROM s)")
def slug_numbering(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", F.col("source").alias("slug"))
    return O.numbered_slugs(own, "slug", "doc_id").select("doc_id", "numbered")


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(p_brand, '\\s+', ' ', 'g'))) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_wins_dedupe(spark, folder):
    own = table(spark, folder, "part").select("p_partkey", "p_brand", F.lower(S.collapsed("p_brand")).alias("key"))
    return O.first_wins(own, "key", "p_partkey").select("p_partkey", "p_brand")


@query(ADMISSION.replace("SELECT seq, url, CASE", ", r AS (SELECT seq, CASE").replace("AS reject_reason FROM e", "AS reason FROM e)") + " SELECT seq // 100000 AS page_id, count(*) FILTER (reason IS NULL) AS discovered, count(*) FILTER (reason IS NOT NULL) AS duplicates FROM r GROUP BY 1")
def source_counters(spark, folder):
    decided = O.admission(candidates(spark, folder), [], cap=2).withColumn("page_id", F.floor(F.col("seq") / 100_000))
    return O.source_counters(decided, "page_id").select("page_id", "discovered", "duplicates")


@query(LINKS + ", x AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+') || href AS target FROM l) SELECT target FROM x ANTI JOIN pages ON x.target = pages.url")
def links_not_captured(spark, folder):
    return O.pending(candidates(spark, folder).select("url"), pages(spark, folder).select("url")).select(F.col("url").alias("target"))


# Robots files of the pages' sites: of some pages the start of the path is barred, of others the whole path is allowed.
ROBOTS = """WITH p AS (SELECT page_id, regexp_extract(lower(url), '^https?://[^/?#]+') AS origin, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages),
r AS (SELECT origin, false AS allow, substr(path, 1, CAST(3 + page_id % 4 AS INT)) AS prefix FROM p WHERE page_id % 5 = 0 UNION SELECT origin, true, path FROM p WHERE page_id % 7 = 0)
"""


def robots_files(spark, folder):
    own = table(spark, folder, "pages").select("page_id", U.origin("url").alias("origin"), U.path("url").alias("path"))
    barred = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("Disallow: "), F.expr("substring(path, 1, cast(3 + page_id % 4 as int))")))
    allowed = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("allow :"), F.col("path"), F.lit(" # open")))
    lines = own.select("origin", F.explode(F.array_compact(F.array(barred, allowed, F.when(F.col("page_id") % 11 == 0, F.lit("Disallow:"))))).alias("line"))
    head = F.lit("User-agent: other\r\nDisallow: /\nUser-Agent: *\n")
    return lines.groupBy("origin").agg(F.concat(head, F.array_join(F.array_sort(F.collect_set("line")), "\n")).alias("body"))


@query(ROBOTS + "SELECT DISTINCT r.origin, allow, prefix FROM r")
def robots_prefixes(spark, folder):
    return O.robots_rules(robots_files(spark, folder)).distinct()


@query(ROBOTS + "SELECT page_id, coalesce(bool_or(NOT allow) AND NOT bool_or(allow), false) AS blocked FROM p LEFT JOIN r ON p.origin = r.origin AND starts_with(path, prefix) GROUP BY page_id")
def robots_blocked(spark, folder):
    own = table(spark, folder, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("normalized"))
    barred = O.blocked_by_robots(own, O.robots_rules(robots_files(spark, folder))).withColumn("blocked", F.lit(True))
    return own.join(barred, "seq", "left").select(F.col("seq").alias("page_id"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
