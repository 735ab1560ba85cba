"""Query of the plan of safe corrections, over comparisons that stand for the pages by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import corrections as C
from siltstone.registry import query
from siltstone.sources.tables import table

SITE = "concat('site', cast(page_id % 60 as int))"
#: The same in Spark's and DuckDB's SQL, by the page's number.
FAILS = {d: f"case when page_id % {11 + 2 * i} = 0 then false when page_id % 5 = 0 then null else true end" for i, d in enumerate(C.DIMENSIONS)}
FLAGS = {
    "height_mismatch": "page_id % 4 = 0", "height_ratio": "1.0 + (page_id % 3) / 10.0", "content_mismatch": "page_id % 31 = 0", "structure_mismatch": "page_id % 37 = 0", "responsive_mismatch": "case when page_id % 41 = 0 then true end",
    "header_present": "page_id % 43 <> 0", "footer_present": "case when page_id % 47 <> 0 then true end", "broken_images": "case when page_id % 53 = 0 then 2 else 0 end", "style_sheets": "case when page_id % 59 <> 0 then 3 end", "missing_fonts": "case when page_id % 61 = 0 then 1 else 0 end",
}
BLOCKER = "case page_id % 9 when 0 then 'div.site-preloader.x' when 1 then 'div.cookie-bar' when 2 then 'a.hero' when 3 then 'div' end"
TEMPLATE = "case when page_id % 6 = 0 then '<p>a</p><div class=\"spacer lg\"> &nbsp; </div>' else '<div class=\"spacer\">text</div>' end"


@query(
    f"""WITH p AS (SELECT page_id, {SITE} AS site, 's' || page_id AS slug, {", ".join(f"{v} AS {k}" for k, v in {**FLAGS, **FAILS}.items())}, {BLOCKER} AS blocker, {TEMPLATE} AS html FROM pages),
f AS (SELECT site, 0 AS part, page_id, n, what FROM (
 {" UNION ALL ".join([f"SELECT site, page_id, {i} AS n, '{k}:' || slug AS what FROM p WHERE {k}_mismatch" for i, k in enumerate(("content", "structure", "responsive"))])}
 UNION ALL {" UNION ALL ".join(f"SELECT site, page_id, {10 + 10 * v + i}, '{d}:' || slug || ':{name}' FROM p WHERE NOT {d}" for v, name in enumerate(("wide", "unknown")) for i, d in enumerate(C.DIMENSIONS))}
 UNION ALL {" UNION ALL ".join(f"SELECT site, page_id, {50 + i}, '{k}:' || slug FROM p WHERE {when}" for i, (k, when) in enumerate((("header", "NOT header_present"), ("footer", "footer_present IS NULL"), ("media", "broken_images > 0"), ("css", "style_sheets IS NULL"), ("fonts", "missing_fonts > 0"))))})
 UNION ALL SELECT site, 1, page_id, 0, 'blocked-click:Buy' FROM p WHERE page_id % 9 = 2 UNION ALL SELECT site, 1, page_id, 0, 'blocked-click:Buy' FROM p WHERE page_id % 9 = 0),
o AS (SELECT site, what, min((part, page_id, n)) AS at_first FROM f GROUP BY site, what),
u AS (SELECT site, string_agg(what, '|' ORDER BY at_first) AS unresolved FROM o GROUP BY site),
t AS (SELECT site, string_agg(DISTINCT c, '|' ORDER BY c) AS technical FROM (SELECT site, CASE page_id % 9 WHEN 0 THEN 'site-preloader' WHEN 1 THEN 'cookie-bar' END AS c FROM p) WHERE c IS NOT NULL GROUP BY site),
s AS (SELECT site, count(*) AS pages, bool_or(height_mismatch AND height_ratio > 1.1) AND bool_or(page_id % 6 = 0) AS a, bool_or(page_id % 9 IN (0, 1)) AS b, bool_or(coalesce(NOT positions, false) OR coalesce(NOT structure, false)) AS c FROM p GROUP BY site),
x AS (SELECT site, pages, concat_ws('|', CASE WHEN a THEN 'remove-empty-spacers' END, CASE WHEN b THEN 'disable-technical-click-blockers' END, CASE WHEN c THEN 'repair-native-commerce-responsive-layout' END) AS applied FROM s)
SELECT site, pages, applied, coalesce(unresolved, '') AS unresolved, coalesce(technical, '') AS technical, CASE WHEN applied <> '' THEN 'corrected-revalidation-required' WHEN unresolved IS NOT NULL THEN 'needs-review' ELSE 'no-safe-correction-needed' END AS status FROM x LEFT JOIN u USING (site) LEFT JOIN t USING (site)"""
)
def correction_plan(spark, folder):
    own = table(spark, folder, "pages").select("page_id", F.expr(SITE).alias("site"), F.concat(F.lit("s"), "page_id").alias("slug"), *[F.expr(v).alias(k) for k, v in FLAGS.items()], F.expr(BLOCKER).alias("blocker"), F.expr(TEMPLATE).alias("html"), *[F.expr(v).alias(d) for d, v in FAILS.items()])
    sizes = F.array(*[F.struct(F.lit(name).cast("string").alias("viewport"), *C.DIMENSIONS) for name in ("wide", None)])
    results = own.select("site", F.col("page_id").alias("place"), "slug", *FLAGS, sizes.alias("viewports"))
    clicks = own.where("blocker is not null").select("site", F.col("page_id").alias("place"), "blocker", F.when(F.col("page_id") % 9 != 3, F.lit("Buy")).alias("text"))
    return C.plan(results, clicks, own.select("site", "html")).withColumns({c: F.array_join(c, "|") for c in ("applied", "unresolved", "technical")})
