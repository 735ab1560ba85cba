"""Queries over the elements of pages derived from the tables: their HTML has sections, menus, forms and components by the page's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import dom
from siltstone.operators import layout as L
from siltstone.registry import query
from siltstone.sources.tables import dealt, table

#: The same text in Spark's and DuckDB's SQL; % stands for the page's number.
HTML = """concat('<html><head><title>t</title></head><body class="b"><header id="top"><nav aria-label="Main"><ul><li><a href="/a%">A <b>%</b></a></li><li><a href="/b?x=1">B</a></li></ul></nav></header>',
 repeat(concat('<div class="row x', page_id % 7, '"><h2>H ', page_id, '</h2><div class="col-1 hero"><p>One <b>two ', page_id, '</b> three</p><img src="/i', page_id % 5, '.png"><img alt="none"></div><div class="grid"><ul>',
  repeat('<li><a href="p.html">go</a></li>', cast(page_id % 12 as int)), '</ul></div><div>', repeat('<p><i>x</i></p>', cast(page_id % 23 as int)), '</div></div>'), cast(case when page_id % 50 = 0 then 44 else page_id % 7 end as int)),
 case when page_id % 3 = 0 then '<main><section><article class="testimonial slider"><h3>Said</h3><div><div><div><div><em>deep</em></div></div></div></div></article></section><form class="wpcf7-form" action="/send" method="post"><input name="q" placeholder="Your  name" required><select name="s"></select></form></main>' else '<p class="lead">none</p>' end,
 case when page_id % 2 = 0 then '<aside class="side widget"><h4>Near</h4><a href="/n">n</a></aside>' else '' end, '<footer class="site-footer"><ul><li><a href="/f">F</a></li></ul><form></form></footer></body></html>')"""

ADDRESS = "concat('https://site.example/d', cast(page_id % 10 as int), '/p', page_id, '.html')"

# Elements by their tags: an element's last one is the last before its end, its parent the latest element one level up.
TREE = f"""WITH RECURSIVE p AS (SELECT page_id, {ADDRESS} AS url, {HTML} AS html FROM pages),
t AS (SELECT url, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT url, regexp_extract_all(html, '<[^>]+>|[^<]+') AS toks FROM p)),
k AS (SELECT url, pos, tok, CASE WHEN tok[1] <> '<' THEN 'text' WHEN tok[2] = '/' THEN 'end' WHEN regexp_matches(tok, '^<(img|input)\\b') THEN 'void' ELSE 'open' END AS kind FROM t),
c AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER w AS level, count(*) FILTER (kind IN ('open', 'void')) OVER w AS seen, lag(pos) OVER w AS before FROM k WINDOW w AS (PARTITION BY url ORDER BY pos ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CASE kind WHEN 'open' THEN level WHEN 'end' THEN level + 1 WHEN 'void' THEN level + 1 END AS depth FROM c),
o AS (SELECT *, lead(seen) OVER w AS last, lead(pos) OVER w AS until FROM e WHERE kind IN ('open', 'end') WINDOW w AS (PARTITION BY url, depth ORDER BY pos)),
n AS MATERIALIZED (SELECT url, seen AS node, last, depth, pos, until, tok FROM o WHERE kind = 'open' UNION ALL SELECT url, seen, seen, depth, pos, pos, tok FROM e WHERE kind = 'void'),
q AS (SELECT n.*, coalesce(u.node, 0) AS parent, regexp_extract(u.tok, '^<([a-z0-9]+)', 1) AS parent_tag FROM n ASOF LEFT JOIN n u ON n.url = u.url AND n.depth - 1 = u.depth AND n.node > u.node),
x AS (SELECT url, n.node, string_agg(t.tok, '' ORDER BY t.pos) AS said FROM n JOIN t USING (url) WHERE t.pos BETWEEN n.pos AND n.until AND t.tok[1] <> '<' GROUP BY url, n.node),
a AS MATERIALIZED (SELECT q.*, row_number() OVER (PARTITION BY url, parent ORDER BY node) - 1 AS nth, regexp_extract(tok, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(tok, 'class="([^"]*)"', 1) AS class, regexp_extract(tok, ' id="([^"]*)"', 1) AS name,
 coalesce(trim(regexp_replace(said, '\\s+', ' ', 'g')), '') AS text FROM q LEFT JOIN x USING (url, node)),
"""
SLUG = "substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)"
KIND = """CASE WHEN tag = 'form' THEN 'form' WHEN tag = 'img' THEN 'image' WHEN tag = 'a' THEN 'navigation' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'p' THEN 'paragraph' WHEN tag IN ('ul', 'li') THEN 'list'
 WHEN contains(class, 'slider') THEN 'carousel' WHEN contains(class, 'testimonial') THEN 'paragraph' WHEN contains(class, 'grid') THEN 'section' WHEN contains(class, 'col') THEN 'column' ELSE 'unknown' END"""

# Sections: the outermost of the first 80 elements that look like one, at most 40.
ROOTS = (
    TREE
    + """r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY node) AS n FROM a WHERE (tag IN ('section', 'article', 'div') AND parent_tag IN ('main', 'body')) OR regexp_matches(class, 'section|hero|banner|container|wrapper|row|grid|columns')),
m AS (SELECT * FROM r WHERE n <= 80 QUALIFY coalesce(max(last) OVER (PARTITION BY url ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < node),
s AS MATERIALIZED (SELECT url, row_number() OVER (PARTITION BY url ORDER BY node) - 1 AS section, node, last, tag, class, name, text FROM m UNION ALL
 SELECT a.url, a.nth, a.node, a.last, a.tag, a.class, a.name, a.text FROM a JOIN a b ON a.url = b.url AND a.parent = b.node WHERE b.tag = 'body' AND a.nth < 20 AND a.url NOT IN (SELECT url FROM m)),
"""
)


def elements(spark, folder):
    """The elements of the derived pages, as dom.node_rows gives them."""
    return dom.node_rows(pages(spark, folder))


def pages(spark, folder):
    return dealt(table(spark, folder, "pages").select("page_id")).select(F.expr(ADDRESS).alias("url"), F.expr(HTML).alias("html"))


@query(TREE + "z AS (SELECT 1) SELECT url, node, parent, last, depth, nth, tag, substr(text, 1, 240) AS text FROM a")
def page_elements(spark, folder):
    long = lambda c: F.col(c).cast("long").alias(c)
    return elements(spark, folder).select("url", *[long(c) for c in ("node", "parent", "last", "depth", "nth")], "tag", F.substring("lead", 1, 240).alias("text"))


@query(
    ROOTS
    + f"""h AS (SELECT url, parent, count(*) FILTER (regexp_matches(class, '(?i)col|column|wp-block-column|grid|cell')) AS columns FROM a GROUP BY url, parent)
SELECT s.url, section, 'section:' || {SLUG.format("s.url || '-' || section || '-' || upper(tag) || '-' || class")} AS section_id, {KIND.replace("'unknown'", "CASE WHEN contains(class, 'row') THEN 'unknown' ELSE 'unknown' END")} AS type, tag, greatest(coalesce(columns, 0), 1) AS columns, last - node AS elements
 FROM s LEFT JOIN h ON h.url = s.url AND h.parent = s.node"""
)
def layout_sections(spark, folder):
    found = L.sections(L.in_sections(elements(spark, folder)))
    return found.withColumns({c: F.col(c).cast("long") for c in ("section", "columns", "elements")})


@query(
    ROOTS
    + f"""g AS (SELECT a.*, s.section, 1 AS level, s.section * 100 + a.nth AS place FROM a JOIN s ON a.url = s.url AND a.parent = s.node WHERE a.nth < 20
 UNION ALL SELECT a.*, g.section, g.level + 1, g.place * 10 + a.nth + 1 FROM a JOIN g ON a.url = g.url AND a.parent = g.node WHERE a.nth < 8),
i AS (SELECT url, node, regexp_extract(tok, 'src="([^"]*)"', 1) AS src FROM a WHERE tag = 'img' AND contains(tok, 'src=')),
j AS (SELECT g.url, g.node, count(*) AS images FROM g JOIN i ON g.url = i.url AND i.node > g.node AND i.node <= g.last GROUP BY g.url, g.node)
SELECT url, section, level, node, parent, place::VARCHAR AS place, 'block:' || {SLUG.format("url || '-' || place || '-' || upper(tag) || '-' || text")} AS block_id, {KIND.replace("ELSE 'unknown'", "WHEN contains(class, 'hero') THEN 'section' ELSE 'unknown'")} AS type, tag, nullif(substr(text, 1, 240), '') AS text, coalesce(images, 0) AS images
 FROM g LEFT JOIN j USING (url, node)"""
)
def layout_blocks(spark, folder):
    found = L.blocks(L.in_sections(elements(spark, folder))).withColumn("images", F.size("media")).drop("media")
    return found.withColumns({c: F.col(c).cast("long") for c in ("section", "level", "node", "parent", "images")})


@query(
    TREE
    + f"""v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY node) - 1 AS menu FROM a WHERE tag = 'nav' OR (tag = 'ul' AND EXISTS (SELECT 1 FROM a b WHERE b.url = a.url AND b.tag IN ('header', 'footer') AND b.node < a.node AND a.node <= b.last))),
l AS (SELECT v.url, v.menu, CASE WHEN v.menu = 0 THEN 'primary' ELSE 'secondary' END AS position, regexp_extract(v.tok, 'aria-label="([^"]*)"', 1) AS label, a.text, regexp_extract(a.tok, 'href="([^"]*)"', 1) AS href, row_number() OVER (PARTITION BY v.url, v.menu ORDER BY a.node) - 1 AS item
 FROM v JOIN a ON v.url = a.url AND a.node > v.node AND a.node <= v.last WHERE a.tag = 'a')
SELECT url, menu, 'menu:' || {SLUG.format("url || '-' || menu || '-' || position")} AS menu_id, position, CASE WHEN label = '' THEN position || ' menu' ELSE label END AS name, item,
 'nav-item:' || {SLUG.format("url || '-' || menu || '-' || item || '-' || text")} AS item_id, text AS label, 'https://site.example' || href AS href FROM l WHERE item < 80"""
)
def page_menus(spark, folder):
    return L.menus(elements(spark, folder)).withColumns({c: F.col(c).cast("long") for c in ("menu", "item")})


@query(
    TREE
    + """f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY node) - 1 AS form FROM a WHERE tag = 'form'),
d AS (SELECT f.url, f.form, f.class, f.tok AS form_tok, a.tok, a.tag, row_number() OVER (PARTITION BY f.url, f.form ORDER BY a.node) - 1 AS field FROM f LEFT JOIN a ON f.url = a.url AND a.node > f.node AND a.node <= f.last AND a.tag IN ('input', 'select', 'textarea'))
SELECT url, form, CASE WHEN contains(class, 'wpcf7') THEN 'Contact Form 7' END AS provider, nullif(regexp_extract(form_tok, 'action="([^"]*)"', 1), '') AS action, nullif(regexp_extract(form_tok, 'method="([^"]*)"', 1), '') AS method,
 CASE WHEN tok IS NOT NULL THEN field END AS field, nullif(regexp_extract(tok, ' name="([^"]*)"', 1), '') AS name, nullif(regexp_replace(regexp_extract(tok, 'placeholder="([^"]*)"', 1), '\\s+', ' ', 'g'), '') AS label, tag AS type, contains(tok, 'required') AS required FROM d"""
)
def page_forms(spark, folder):
    own = L.forms(elements(spark, folder))
    return own.select("url", F.col("form").cast("long").alias("form"), "provider", "action", "method", F.col("field").cast("long").alias("field"), "name", "label", "type", "required")


@query(
    TREE
    + f"""m AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY node) - 1 AS place FROM a WHERE tag = 'form' OR regexp_matches(class, 'slider|swiper|carousel|accordion|tab|faq|testimonial|grid|banner|hero|cta|newsletter')),
h AS (SELECT url, parent AS node, count(*) AS items FROM a GROUP BY url, parent),
y AS (SELECT m.*, {KIND.replace("ELSE 'unknown'", "WHEN contains(class, 'hero') THEN 'section' ELSE 'unknown'")} AS type FROM m WHERE place < 120)
SELECT url, place, 'component:' || {SLUG.format("url || '-' || place || '-' || type")} AS component_id, type, tag, class AS classes, coalesce(items, 0) AS items FROM y LEFT JOIN h USING (url, node)"""
)
def page_components(spark, folder):
    own = L.components(elements(spark, folder)).drop("provider", "media")
    return own.withColumns({c: F.col(c).cast("long") for c in ("place", "items")})


@query(
    TREE
    + f"""w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY node) - 1 AS place FROM a WHERE contains(class, 'widget') OR tag = 'aside'),
h AS (SELECT w.url, w.node, min_by(a.text, a.node) AS title FROM w JOIN a ON a.url = w.url AND a.node > w.node AND a.node <= w.last WHERE regexp_matches(a.tag, '^h[1-6]$') GROUP BY w.url, w.node)
SELECT url, place, 'widget:' || {SLUG.format("url || '-' || place || '-' || class")} AS widget_id, class AS type, title, text FROM w LEFT JOIN h USING (url, node) WHERE place < 80"""
)
def page_widgets(spark, folder):
    return L.widgets(elements(spark, folder)).drop("media").withColumn("place", F.col("place").cast("long"))
