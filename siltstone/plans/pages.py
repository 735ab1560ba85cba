"""Page-quality queries over the table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as S
from siltstone.functions import urls as U
from siltstone.operators import dom as D
from siltstone.operators import rules as R
from siltstone.registry import query
from siltstone.sources.tables import table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


# Pieces of the DuckDB SQL that several queries share.
TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{00A0}]+', ' ', 'g')), '')"
H1S = "len(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))"
BODY = "regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?s)<[^>]*>', '', 'g')"
WORDS = rf"len(list_filter(regexp_split_to_array({BODY}, '\s+'), lambda x: x <> ''))"
HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
HTML_BYTES = "octet_length(encode(html))"
# every page of the table is a plain one: no description, canonical link, Open Graph or Twitter card
ISSUES = f"""WITH f AS (SELECT page_id, url, {HOST} AS host, {TITLE} AS title, {H1S} AS h1, {WORDS} AS words, {HTML_BYTES} AS bytes, html FROM pages),
i AS (SELECT page_id, url, host, title, list_filter([
 CASE WHEN title IS NULL THEN 'TITLE_MISSING' END, CASE WHEN title IS NOT NULL AND (length(title) < 20 OR length(title) > 65) THEN 'TITLE_LENGTH' END, 'DESCRIPTION_MISSING', 'CANONICAL_MISSING',
 CASE WHEN length(url) > 115 THEN 'URL_TOO_LONG' END, CASE WHEN h1 = 0 THEN 'H1_MISSING' END, CASE WHEN h1 > 1 THEN 'H1_MULTIPLE' END, 'OPEN_GRAPH_INCOMPLETE', 'TWITTER_CARD_INCOMPLETE',
 CASE WHEN words > 0 AND words < 250 THEN 'THIN_CONTENT' END, CASE WHEN bytes > 800000 THEN 'HTML_TOO_LARGE' END], lambda x: x IS NOT NULL) AS codes FROM f),
l AS (SELECT page_id, url, host, title, codes, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS place FROM i),
s AS (SELECT *, CASE WHEN code IN ('TITLE_MISSING', 'DESCRIPTION_MISSING') THEN 'critical' WHEN code = 'TWITTER_CARD_INCOMPLETE' THEN 'info' ELSE 'warning' END AS severity FROM l)
"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    own = pages(spark, folder).withColumn("host", U.host("url"))
    return R.page_issues(R.features(own))


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title_norm(spark, folder):
    return pages(spark, folder).select("page_id", H.title("html").alias("title"))


@query(f"""WITH t AS (SELECT page_id, {TITLE} AS title FROM pages)
SELECT page_id, length(title) AS units, title IS NULL AS missing, coalesce(length(title) NOT BETWEEN 20 AND 65, false) AS bad_length, coalesce(length(title) NOT BETWEEN 40 AND 58, false) AS bad_length_strict FROM t""")
def page_title_length_issue(spark, folder):
    own = pages(spark, folder).select("page_id", H.title("html").alias("title"))
    units = S.utf16_length("title")
    outside = lambda a, b: F.coalesce(~units.between(a, b), F.lit(False))
    return own.select("page_id", units.cast("long").alias("units"), F.col("title").isNull().alias("missing"), outside(20, 65).alias("bad_length"), outside(40, 58).alias("bad_length_strict"))


@query(f"SELECT page_id, {H1S} AS h1_count, {H1S} = 0 AS missing, {H1S} > 1 AS multiple, len(regexp_extract_all(html, '(?is)<p[\\s/>]')) AS paragraphs FROM pages")
def page_h1_issue(spark, folder):
    n = F.size(H.headings("html", 1)).cast("long")
    return pages(spark, folder).select("page_id", n.alias("h1_count"), (n == 0).alias("missing"), (n > 1).alias("multiple"), H.count_tag("html", "p").cast("long").alias("paragraphs"))


@query("SELECT page_id, length(url) AS length, length(url) > 115 AS too_long, length(url) > 45 AS too_long_strict FROM pages")
def page_url_issue(spark, folder):
    n = S.utf16_length("url").cast("long")
    return pages(spark, folder).select("page_id", n.alias("length"), (n > 115).alias("too_long"), (n > 45).alias("too_long_strict"))


@query(f"SELECT page_id, {HTML_BYTES} AS bytes, {HTML_BYTES} > 800000 AS too_large, {HTML_BYTES} > 8000 AS too_large_strict FROM pages")
def page_html_size(spark, folder):
    n = F.octet_length("html").cast("long")
    return pages(spark, folder).select("page_id", n.alias("bytes"), (n > 800_000).alias("too_large"), (n > 8000).alias("too_large_strict"))


@query(f"WITH w AS (SELECT page_id, {WORDS} AS words FROM pages) SELECT page_id, words, words > 0 AND words < 250 AS thin FROM w")
def page_words_thin(spark, folder):
    own = pages(spark, folder).select("page_id", H.word_count(H.body_text("html")).cast("long").alias("words"))
    return own.withColumn("thin", (F.col("words") > 0) & (F.col("words") < 250))


@query(f"WITH t AS (SELECT url, {TITLE} AS title FROM pages) SELECT title, count(DISTINCT url) AS n_urls, array_to_string(list_sort(list_distinct(list(url))), ' ') AS urls FROM t WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT url) > 1")
def duplicate_titles(spark, folder):
    own = pages(spark, folder).select("url", H.title("html").alias("title"))
    return R.duplicate_groups(own, "title").select("title", F.size("urls").cast("long").alias("n_urls"), F.array_join("urls", " ").alias("urls"))


@query(ISSUES + "SELECT url, place, code, severity FROM s")
def issues_long(spark, folder):
    return R.issues_long(judged(spark, folder)).withColumn("place", F.col("place").cast("long"))


@query(ISSUES + "SELECT code, count(*) AS n, bool_or(severity = 'critical') AS critical FROM s WHERE severity <> 'info' GROUP BY code")
def issue_counts(spark, folder):
    return R.issue_counts(R.issues_long(judged(spark, folder)))


@query(ISSUES + "SELECT host, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM s GROUP BY host")
def severity_counts(spark, folder):
    return R.severity_counts(R.issues_long(judged(spark, folder), "host"), "host")


SITE_SCORE = (
    ISSUES
    + """, own AS (SELECT host, count(DISTINCT page_id) AS pages, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM s GROUP BY host),
d AS (SELECT host, count(*) AS copies FROM (SELECT host, title FROM i WHERE title IS NOT NULL GROUP BY host, title HAVING count(DISTINCT url) > 1) GROUP BY host),
j AS (SELECT host, pages, critical, warning + coalesce(copies, 0) AS warning, info FROM own LEFT JOIN d USING (host))
SELECT host, pages, critical, warning, info, 8 * critical + 3 * warning + info AS penalty, greatest(least(100 - (8 * critical + 3 * warning + info), 100), 0) AS score FROM j"""
)


@query(SITE_SCORE)
def site_score(spark, folder):
    return R.site_scores(judged(spark, folder), "host")


@query(f"""SELECT count(*) AS pages, count(*) AS valid, 0::BIGINT AS broken, 0::BIGINT AS redirects, count(*) FILTER ({TITLE} IS NULL) AS without_title, count(*) AS without_description,
 0::BIGINT AS noindex, count(*) FILTER ({WORDS} > 0 AND {WORDS} < 250) AS thin FROM pages""")
def site_summary(spark, folder):
    return R.summary(judged(spark, folder)).drop("broken_links")


@query(ISSUES + "SELECT url, array_to_string(list_slice(codes, 1, 3), ',') AS codes FROM i")
def page_top3_issues(spark, folder):
    return R.top_codes(judged(spark, folder)).withColumn("codes", F.array_join("codes", ","))


LINKS = r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages),
l AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS place FROM a)
"""


def links(spark: SparkSession, folder: str) -> DataFrame:
    """All links of all pages in page order: page_id, url, place, href and the resolved target."""
    own = pages(spark, folder).select("page_id", "url", F.posexplode(H.hrefs("html")).alias("place", "href"))
    return own.withColumn("place", F.col("place").cast("long")).withColumn("target", U.resolved("href", "url"))


@query(LINKS + "SELECT page_id, place, href, regexp_extract(url, '^https?://[^/?#]+') || href AS target FROM l")
def page_links(spark, folder):
    return links(spark, folder).select("page_id", "place", "href", "target")


@query(LINKS + ", t AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || href AS target FROM l) SELECT page_id, count(DISTINCT target) AS internal, 0::BIGINT AS external FROM t GROUP BY page_id")
def page_links_internal_external(spark, folder):
    inner = U.origin("target") == U.origin("url")
    return links(spark, folder).groupBy("page_id").agg(F.countDistinct(F.when(inner, F.col("target"))).alias("internal"), F.countDistinct(F.when(~inner, F.col("target"))).alias("external"))


EVIDENCE = {"sections": "section|article|main|header|footer|nav|aside", "texts": "h1|h2|h3|h4|h5|h6|p|li|span", "media": "img|video|audio|picture|svg|iframe", "links": "a", "forms": "form|input|select|textarea|button"}


@query("SELECT page_id, " + ", ".join(rf"len(regexp_extract_all(html, '(?i)<({tags})[\s/>]'))::BIGINT AS {name}" for name, tags in EVIDENCE.items()) + " FROM pages")
def content_evidence(spark, folder):
    own = pages(spark, folder).select("page_id", H.content_evidence("html").alias("x"))
    return own.select("page_id", *[F.col(f"x.{name}").cast("long").alias(name) for name in EVIDENCE])


@query(f"""WITH f AS (SELECT page_id, url, lower(coalesce({TITLE}, '')) || '||' || len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS fingerprint FROM pages)
SELECT page_id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY page_id) = 1 AS kept FROM f""")
def content_fingerprint_dups(spark, folder):
    from siltstone.operators.frontier import content_fingerprint, first_wins

    own = pages(spark, folder).select("page_id", content_fingerprint(H.title("html"), F.lit(None).cast("string"), F.size(H.hrefs("html"))).alias("fingerprint"))
    return first_wins(own, "fingerprint", "page_id", mark="kept")


@query(r"""WITH f AS (SELECT page_id, regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1) AS fragment FROM pages),
k AS (SELECT substr(regexp_replace(regexp_replace(regexp_replace(fragment, 'https?://[^\s"''<>]+', '{url}', 'g'), '[0-9]+', '{n}', 'g'), '\s+', ' ', 'g'), 1, 12) AS key, fragment, page_id FROM f WHERE fragment <> '')
SELECT key, count(*) AS n, max(length(fragment)) AS longest FROM k GROUP BY key""")
def fragment_consensus(spark, folder):
    own = pages(spark, folder).select("page_id", F.regexp_extract("html", r"(?is)<footer[^>]*>(.*?)</footer>", 1).alias("fragment")).where("fragment <> ''")
    own = own.withColumn("key", F.substring(S.masked_fragment("fragment"), 1, 12))
    return own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("fragment")).cast("long").alias("longest"))


@query(r"""WITH f AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, nullif(lower(regexp_extract(html, '(?is)<html[^>]*?\slang\s*=\s*["'']([^"'']+)["'']', 1)), '') AS locale, regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1) AS fragment FROM pages),
k AS (SELECT site, locale, fragment, substr(regexp_replace(regexp_replace(regexp_replace(fragment, 'https?://[^\s"''<>]+', '{url}', 'g'), '[0-9]+', '{n}', 'g'), '\s+', ' ', 'g'), 1, 600) AS key FROM f WHERE fragment <> ''),
g AS (SELECT site, locale, key, count(*) AS n, arg_max(fragment, (length(fragment), fragment)) AS fragment FROM k GROUP BY ALL)
SELECT site, locale, n, fragment FROM g QUALIFY row_number() OVER (PARTITION BY site, locale ORDER BY n DESC, length(fragment) DESC, fragment DESC) = 1""")
def fragment_winners(spark, folder):
    """The whole job of the operator: of each host and page language the footer that most pages share, by 600 characters."""
    from siltstone.operators.site import fragment_consensus as winners

    own = pages(spark, folder).select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("site"), H.language("html").alias("locale"), F.regexp_extract("html", r"(?is)<footer[^>]*>(.*?)</footer>", 1).alias("fragment"))
    return winners(own.where("fragment <> ''"))


@query(f"SELECT page_id, lower(regexp_extract(html, '(?is)<html[^>]*?\\slang\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS lang, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) AS items FROM pages")
def page_language(spark, folder):
    return pages(spark, folder).select("page_id", H.language("html").alias("lang"), F.size(F.regexp_extract_all("html", F.lit("(?is)<li[^>]*>(.*?)</li>"), 1)).cast("long").alias("items"))


#: Pages with more styles by their number: in elements and attributes; the same text in Spark's and DuckDB's SQL.
STYLED = """concat(replace(html, '</head>', concat('<style>:root{--main-', cast(page_id % 3 as int), ': #', cast(100 + page_id % 900 as int), '; --gap: 4px} a { color: #FFF; font-size: ', cast(page_id % 5 as int), 'px; font-weight: 700;background:linear-gradient(red, #000);box-shadow: 0 0 1px rgba(0, 0, 0, .5); border-radius: 3px}</style></head>')),
 '<p style="margin: ', cast(page_id % 7 as int), 'px; margin-top: 9px; gap : 1px; font-family: Arial, serif"></p><p style="padding:0;--gap:5px"></p><style>b { COLOR: hsl(1, 2%, 3%); Padding: 0; margin: 1px }</style>')"""
CSS = rf"array_to_string(regexp_extract_all({STYLED}, '(?s)<style>(.*?)</style>', 1), chr(10)) || chr(10) || array_to_string(regexp_extract_all({STYLED}, ' style=\"([^\"]*)\"', 1), ';')"
IN_ORDER = "list_filter({x}, lambda v, i: v <> '' AND list_position(list_transform({x}, lambda z: lower(z)), lower(v)) = i)"


def _tokens(name: str, pattern: str, group: int, most: int) -> str:
    found = f"list_transform(regexp_extract_all(css, '(?i){pattern}', {group}), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
    return f"array_to_string(({IN_ORDER.format(x=found)})[:{most}], '|') AS {name}"


@query(f"WITH c AS (SELECT page_id, {CSS} AS css FROM pages) SELECT page_id, {', '.join(_tokens(*t) for t in H.TOKENS)} FROM c")
def css_tokens(spark, folder):
    own = D.parsed(table(spark, folder, "pages").select("page_id", F.expr(STYLED).alias("html"))).select("page_id", H.css_tokens(D.css()).alias("t"))
    return own.select("page_id", *[F.array_join(F.col(f"t.{name}"), "|").alias(name) for name, *_ in H.TOKENS])


@query(f"""WITH c AS (SELECT page_id, {CSS} AS css FROM pages), v AS (SELECT page_id, unnest(regexp_extract_all(css, '(?i){H.VARIABLE}', 1)) AS name, unnest(regexp_extract_all(css, '(?i){H.VARIABLE}', 2)) AS value, generate_subscripts(regexp_extract_all(css, '(?i){H.VARIABLE}', 1), 1) AS n FROM c)
SELECT page_id, name, trim(max_by(value, n)) AS value FROM v GROUP BY page_id, name""")
def css_variables(spark, folder):
    own = D.parsed(table(spark, folder, "pages").select("page_id", F.expr(STYLED).alias("html"))).select("page_id", H.css_tokens(D.css())["variables"].alias("v"))
    return own.select("page_id", F.explode("v").alias("name", "value"))


@query(f"""WITH c AS (SELECT page_id, {CSS} AS css FROM pages), f AS (SELECT page_id, list_transform(regexp_extract_all(css, '(?i){H.SPACING}', 1), lambda x: trim(x)) AS found FROM c)
SELECT page_id, array_to_string(list_filter(found, lambda v, i: list_position(found, v) = i), ',') AS spacing FROM f""")
def css_spacing(spark, folder):
    own = D.parsed(table(spark, folder, "pages").select("page_id", F.expr(STYLED).alias("html"))).select("page_id", H.css_spacing(D.css()).alias("s"))
    return own.select("page_id", F.array_join("s", ",").alias("spacing"))


@query(f"""WITH t AS (SELECT page_id, {TITLE} AS title FROM pages)
SELECT page_id, CASE WHEN length(title) <= 30 THEN title ELSE substr(trim(regexp_replace(substr(title, 1, 31), '\\s+\\S*$', '')), 1, 30) END AS short_title FROM t""")
def title_trimmed(spark, folder):
    own = pages(spark, folder).select("page_id", H.title("html").alias("title"))
    return own.select("page_id", S.trimmed_to("title", 30).alias("short_title"))


@query(f"SELECT page_id, '\"' || replace(coalesce({TITLE}, ''), '\"', '\"\"') || '\"' AS cell, replace(replace(replace(replace(replace({TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def title_escaped(spark, folder):
    own = pages(spark, folder).select("page_id", H.title("html").alias("title"))
    return own.select("page_id", S.csv_cell("title").alias("cell"), S.html_escaped("title").alias("escaped"))
