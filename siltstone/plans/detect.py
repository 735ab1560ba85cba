"""Queries of what sites are built with, over pages with signs by their number; the SQL tries every pattern on every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import detect as D
from siltstone.registry import query
from siltstone.sources.tables import table

#: The same text in Spark's and DuckDB's SQL: some of forty scraps, by the page's number.
SCRAPS = (
    '<meta name="generator" content="WordPress 6.4.2">', '<meta content="PrestaShop" name="generator">', '<link href="/WP-Content/themes/Astra-Child/style.css?v=1">', '<script src="https://cdn.shopify.com/s.js"></script>', "<script>Shopify.theme = 1</script>",
    '<div class="wc-block kt-row">', "<script src=/bootstrap.min.css>", "<link href=bootstrap.bundle.css>", '<div class="tw-flex">', '<div data-elementor-type="x" class="elementor-pro">', '<i class="vc_row et_pb_1 fl-module uagb-x">',
    "rank-math yoast acf-field wpml polylang", '<div class="wp-block-group wpcf7 wpforms fluentform cky-banner cmplz-x">', "<script>window.__NEXT_DATA__={}</script>", "<script>window.__nuxt__={}</script>", "wordpress  5.9 wixstatic.com", "data-wf-page astro-island data-mage-init",
    "spectra oxygen gb-container kadence genesis generatepress bricks- squarespace",
)
HTML = "concat('<html><body>', " + ", ".join(f"case when (page_id * {7 + i}) % {3 + i} = 0 then '{s}' else '' end" for i, s in enumerate(SCRAPS)) + ", '</body></html>')"
SITE = "concat('site', cast(page_id % 40 as int))"

PATTERNS = ", ".join("({}, '{}', '{}', '{}', {})".format(i, kind, name, pattern.replace("'", "''"), sure) for i, (kind, name, pattern, sure) in enumerate(D.RULES))
GENERATOR = "CASE WHEN kind = 'platform' THEN coalesce(nullif(regexp_extract(html, '(?i)<meta name=\"generator\" content=\"([^\"]*)\"', 1), ''), regexp_extract(html, '(?i)<meta content=\"([^\"]*)\" name=\"generator\"', 1)) || chr(10) ELSE '' END || html"


def tried(group: int) -> str:
    """SQL of what each rule's pattern, or its group, matches."""
    found = lambda pattern: "regexp_extract(said, '(?i){}', {})".format(pattern.replace("'", "''"), group)
    return " ".join(f"WHEN {n} THEN {found(pattern) if not group or '([' in pattern else chr(39) * 2}" for n, (_, _, pattern, _) in enumerate(D.RULES))


SIGNS = f"""WITH p AS (SELECT page_id, {SITE} AS site, {HTML} AS html FROM pages), r(n, kind, name, pattern, confidence) AS (VALUES {PATTERNS}),
m AS (SELECT site, page_id, n, kind, name, confidence, CASE n {tried(0)} END AS hit, CASE n {tried(1)} END AS part FROM (SELECT *, {GENERATOR} AS said FROM p CROSS JOIN r)),
f AS MATERIALIZED (SELECT site, n, kind, name, confidence, min(page_id) AS first_page, trim(regexp_replace(min_by(hit, page_id), '\\s+', ' ', 'g')) AS evidence, min_by(part, page_id) AS part FROM m WHERE hit <> '' GROUP BY ALL)
"""


def sites(spark, folder):
    return table(spark, folder, "pages").select(F.expr(SITE).alias("site"), F.col("page_id").alias("place"), F.expr(HTML).alias("html"))


@query(SIGNS + "SELECT site, kind, name, confidence, first_page, evidence, nullif(part, '') AS version, row_number() OVER (PARTITION BY site, kind ORDER BY confidence DESC, n) AS rank FROM f WHERE kind <> 'theme'")
def site_detections(spark, folder):
    return D.detections(sites(spark, folder)).withColumn("rank", F.col("rank").cast("long"))


@query(
    SIGNS
    + """, t AS (SELECT site, max(part) FILTER (kind = 'theme' AND name = 'name') AS active, max(evidence) FILTER (kind = 'theme' AND name = 'name') AS shown, min_by(name, n) FILTER (kind = 'framework') AS framework,
 coalesce(bool_or(kind = 'theme' AND name <> 'name'), false) AS block FROM f WHERE kind IN ('theme', 'framework') GROUP BY site)
SELECT site, active, framework, CASE WHEN block THEN 'block' WHEN active IS NOT NULL THEN 'classic' ELSE 'unknown' END AS type, CASE WHEN active IS NOT NULL THEN 80 WHEN block THEN 65 ELSE 20 END AS confidence,
 concat_ws('|', shown, framework, CASE WHEN block THEN 'block theme markers' END) AS evidence FROM (SELECT DISTINCT site FROM p) LEFT JOIN (SELECT * REPLACE (coalesce(block, false) AS block) FROM t) USING (site)"""
)
def site_themes(spark, folder):
    return D.themes(sites(spark, folder)).withColumn("evidence", F.array_join("evidence", "|"))
