"""Queries of what a crawl is told by, over the derived pages and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import catalog as C
from siltstone.operators import products as P
from siltstone.operators import reports as O
from siltstone.plans.derived import RICH, SHOP, judged, rich_pages, shop_pages
from siltstone.registry import query
from siltstone.sources.tables import table


@query(RICH + """, j AS (SELECT url, string_agg(severity || ':' || code, ' | ' ORDER BY place) AS issues FROM s GROUP BY url)
SELECT i.url, status, title, described AS description_length, CASE WHEN page_id % 3 = 0 THEN i.url WHEN page_id % 3 = 1 THEN i.url || 'x' END AS canonical, CASE WHEN page_id % 11 = 0 THEN 'noindex, nofollow' END AS robots,
 (page_id % 6 = 0)::INT AS missing_alt, words AS word_count, CASE WHEN status >= 400 THEN 'error' WHEN page_id % 11 = 0 THEN 'noindex' ELSE 'indexable' END AS indexability, coalesce(issues, '') AS issues FROM i LEFT JOIN j ON i.url = j.url""")
def page_table(spark, folder):
    own = O.page_table(rich_pages(spark, folder), "page_id")
    return own.select("url", "status", "title", F.length("meta_description").cast("long").alias("description_length"), "canonical", "robots", "missing_alt", F.col("word_count").cast("long").alias("word_count"), "indexability", "issues")


@query(RICH + "SELECT url, coalesce(title, url) AS name, status, array_to_string(codes[:3], ', ') AS first, len(codes) AS n_issues FROM i")
def report_rows(spark, folder):
    return O.report_rows(judged(spark, folder)).withColumn("n_issues", F.col("n_issues").cast("long"))


@query(RICH + """SELECT host, n AS place, url, code, severity FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY severity <> 'critical', url, place) AS n FROM s WHERE severity <> 'info') WHERE n <= 3""")
def site_findings(spark, folder):
    return O.findings(judged(spark, folder), "host").withColumn("place", F.col("place").cast("long"))


@query(SHOP + """, v AS (SELECT site, k, row, type, sku, parent, label, row_number() OVER () AS z FROM (
 SELECT site, k, 0 AS row, CASE WHEN k % 3 = 0 THEN 'variable' ELSE 'simple' END AS type, k::VARCHAR AS sku, '' AS parent, name AS label FROM x
 UNION ALL SELECT site, k, 1, 'variation', 'v' || k || 'a', 'sku:' || k, name || ' - red' FROM x WHERE k % 3 = 0 UNION ALL SELECT site, k, 2, 'variation', 'v' || k || 'b', 'sku:' || k, name FROM x WHERE k % 3 = 0)),
p AS (SELECT site, k, row_number() OVER (PARTITION BY site ORDER BY k) AS product FROM x)
SELECT site, product, row, type, sku, parent, label AS name FROM v JOIN p USING (site, k)""")
def shop_rows(spark, folder):
    own = O.shop_rows(C.merge(P.extract(shop_pages(spark, folder))))
    return own.select("site", "product", "row", F.col("Type").alias("type"), F.col("SKU").alias("sku"), F.col("Parent").alias("parent"), F.col("Name").alias("name"))


@query("SELECT p_partkey, ['Brand', 'Offer', 'Product'] AS types, p_partkey::VARCHAR AS sku FROM part")
def structured_types(spark, folder):
    text = F.expr("""concat('{"@graph":[{"@type":["Product",1],"sku":"', p_partkey, '","offers":[{"@type":"Offer"}],"brand":{"@type":"Brand"}},{"@type":"product","sku":"x"}]}')""")
    own = table(spark, folder, "part").select("p_partkey", F.array(F.lit("{no json"), text).alias("texts"))
    kinds = F.filter(O.schema_types(F.col("texts")), lambda t: t != "product")
    return own.select("p_partkey", kinds.alias("types"), F.get_json_object(O.find_schema(F.col("texts"), "PRODUCT"), "$.sku").alias("sku"))


LINK = """<a\\b[^>]*\\bhref="([^"]*)"[^>]*>"""


@query(f"SELECT page_id, len(regexp_extract_all(html, '(?i){LINK}')) AS links, len(regexp_extract_all(html, '(?i)<form\\b[^>]*>')) AS forms, regexp_extract(html, '(?i){LINK}', 1) AS first_link FROM pages")
def editable_fields(spark, folder):
    own = table(spark, folder, "pages").select("page_id", O.editable_fields("html").alias("f"))
    of = lambda kind: F.filter("f", lambda x: x["kind"] == kind)
    return own.select("page_id", F.size(of("link")).cast("long").alias("links"), F.size(of("form")).cast("long").alias("forms"), F.coalesce(F.get(of("link"), 0)["value"], F.lit("")).alias("first_link"))


@query("""WITH b AS (SELECT c_nationkey, max(c_custkey) AS k FROM customer GROUP BY c_nationkey) SELECT s_suppkey, k AS c_custkey FROM supplier JOIN b ON s_nationkey = c_nationkey""")
def jobs_of_businesses(spark, folder):
    jobs = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("website"))
    known = table(spark, folder, "customer").select(F.col("c_nationkey").alias("website"), "c_custkey", F.col("c_custkey").alias("place"))
    return O.jobs_of_businesses(jobs, known).select("s_suppkey", "c_custkey")
