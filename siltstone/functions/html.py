"""Features of raw HTML as Spark column expressions: patterns over the source, no tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import collapsed

BODY = r"(?is)<body[^>]*>(.*)$"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
# Relations of <link> that name a resource, and attributes that hold one.
RESOURCE_RELATIONS = "stylesheet|preload|modulepreload|icon|shortcut icon|apple-touch-icon"
RESOURCE_EXTENSIONS = "css|js|mjs|png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|eot|mp4|webm|mp3|pdf|json"
CHALLENGE = r"(?i)captcha|cf-challenge|challenge-platform|are you (a )?human|verify you are human|access denied"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title(html: Column | str) -> Column:
    """The text of the first title element, white space collapsed; null if there is none."""
    return collapsed(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column | str, level: int) -> Column:
    """Texts of the headings of a level, empty ones left out."""
    found = F.regexp_extract_all(_c(html), F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), 1)
    return F.filter(F.transform(found, lambda x: F.coalesce(collapsed(F.regexp_replace(x, "<[^>]*>", "")), F.lit(""))), lambda x: x != "")


def count_tag(html: Column | str, *names: str) -> Column:
    return F.regexp_count(_c(html), F.lit(rf"(?i)<({'|'.join(names)})[\s/>]"))


def meta(html: Column | str, name: str) -> Column:
    """Content of the first meta element with this name or property."""
    own, tag = _c(html), rf"""(?is)<meta\s(?=[^>]*(?:name|property)\s*=\s*["']{name}["'])[^>]*?content\s*=\s*(["'])(.*?)\1"""
    return collapsed(F.regexp_extract(own, tag, 2))


def canonical_href(html: Column | str) -> Column:
    return collapsed(F.regexp_extract(_c(html), r"""(?is)<link\s(?=[^>]*rel\s*=\s*["']canonical["'])[^>]*?href\s*=\s*["']([^"']*)["']""", 1))


def body_text(html: Column | str) -> Column:
    """Text of the body as nodes hold it: tags vanish, scripts and styles in it stay."""
    return F.regexp_replace(F.regexp_extract(_c(html), BODY, 1), "(?s)<[^>]*>", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def hrefs(html: Column | str) -> Column:
    """Quoted addresses of all links, in page order."""
    return F.regexp_extract_all(_c(html), F.lit(LINK), 1)


def has_directive(robots: Column | str, word: str) -> Column:
    return F.coalesce(_c(robots).rlike(rf"(?i)\b{word}\b"), F.lit(False))


def is_challenge(html: Column | str) -> Column:
    return _c(html).rlike(CHALLENGE)


def resource_urls(html: Column | str) -> Column:
    """Addresses of resources: of tags, of attributes with a known ending, of srcset, of url() and @import."""
    own = _c(html)
    every = lambda pattern: F.regexp_extract_all(own, F.lit(pattern), 1)
    links = F.regexp_extract_all(own, F.lit(rf"""(?is)<link\s(?=[^>]*rel\s*=\s*["'](?:{RESOURCE_RELATIONS})["'])[^>]*?href\s*=\s*["']([^"']+)["']"""), 1)
    tags = every(r"""(?is)<(?:script|img|source|video|audio|iframe)\s[^>]*?\ssrc\s*=\s*["']([^"']+)["']|^$""")
    tags = F.array_union(tags, every(r"""(?is)<(?:script|img|source|video|audio|iframe)\ssrc\s*=\s*["']([^"']+)["']"""))
    lazy = every(rf"""(?is)\s(?:data-src|data-original|data-bg|poster|content|data-lazy-src)\s*=\s*["']([^"']+\.(?:{RESOURCE_EXTENSIONS})(?:\?[^"']*)?)["']""")
    sets = F.flatten(F.transform(every(r"""(?is)\s(?:data-)?srcset\s*=\s*["']([^"']+)["']"""), lambda s: F.transform(F.split(s, ","), lambda x: F.regexp_extract(F.trim(x), r"^(\S+)", 1))))
    found = F.flatten(F.array(links, tags, lazy, sets, css_urls(own)))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike(r"(?i)^(data:|javascript:|#)")))


def css_urls(css: Column | str) -> Column:
    """Addresses that CSS depends on: url() and @import."""
    own = _c(css)
    inside = F.regexp_extract_all(own, F.lit(r"""(?i)url\(\s*["']?([^"')\s]+)["']?\s*\)"""), 1)
    imported = F.regexp_extract_all(own, F.lit(r"""(?i)@import\s+["']([^"']+)["']"""), 1)
    return F.array_distinct(F.filter(F.concat(inside, imported), lambda x: ~x.rlike("(?i)^data:")))


# What design tokens look like, and how many of a kind are kept.
TOKENS = (
    ("colors", r"#[0-9a-f]{3,8}\b|rgba?\([^)]+\)|hsla?\([^)]+\)", 0, 80),
    ("gradients", r"(?:linear|radial)-gradient\([^)]+\)", 0, 40),
    ("fonts", r"font-family\s*:\s*([^;]+)", 1, 40),
    ("font_sizes", r"font-size\s*:\s*([^;]+)", 1, 40),
    ("font_weights", r"font-weight\s*:\s*([^;]+)", 1, 30),
    ("spacing", r"(?:margin|padding|gap)\s*:\s*([^;]+)", 1, 60),
    ("radii", r"border-radius\s*:\s*([^;]+)", 1, 30),
    ("shadows", r"box-shadow\s*:\s*([^;]+)", 1, 30),
)
VARIABLE = r"(--[a-z0-9-]+)\s*:\s*([^;]+)"


def css_tokens(css: Column | str) -> Column:
    """Design tokens in order of their first use: colours, gradients, fonts, sizes, weights, spacing, radii, shadows; and variables with their last value."""
    own = _c(css)
    every = lambda pattern, group: F.array_distinct(F.transform(F.regexp_extract_all(own, F.lit(f"(?i){pattern}"), group), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    first = lambda found: F.filter(found, lambda x, i: (x != "") & (F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1))  # noqa: E731  in any case
    lists = [F.slice(first(every(pattern, group)), 1, most).alias(name) for name, pattern, group, most in TOKENS]
    named = F.transform(F.regexp_extract_all(own, F.lit(f"(?i){VARIABLE}"), 0), lambda x: F.struct(F.regexp_extract(x, "^--[^:\\s]+", 0).alias("key"), F.trim(F.regexp_replace(x, "(?s)^[^:]*:", "")).alias("value")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
    return F.struct(*lists, F.map_from_entries(last).alias("variables"))


#: Spacing properties with their longhands; a value ends with its declaration or its block.
SPACING = r"(?:margin|padding|gap)[a-z-]*\s*:\s*([^;}]+)"


def css_spacing(css: Column | str) -> Column:
    """All spacing values of margin, padding and gap, longhands too, in order of their first use; none is left out."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(css), F.lit(f"(?i){SPACING}"), 1), lambda x: F.trim(x)))


def content_evidence(html: Column | str) -> Column:
    """Counts of tags by what they show: sections, texts, media, links, forms."""
    return F.struct(
        count_tag(html, "section", "article", "main", "header", "footer", "nav", "aside").alias("sections"),
        count_tag(html, "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "span").alias("texts"),
        count_tag(html, "img", "video", "audio", "picture", "svg", "iframe").alias("media"),
        count_tag(html, "a").alias("links"),
        count_tag(html, "form", "input", "select", "textarea", "button").alias("forms"),
    )


def language(html: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(html), r"""(?is)<html[^>]*?\slang\s*=\s*["']([^"']+)["']""", 1)), F.lit(""))


def visible_text(html: Column | str, limit: int | None = None) -> Column:
    """Text without scripts and styles, tags as spaces, white space collapsed."""
    own = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    own = F.coalesce(collapsed(F.regexp_replace(own, "(?s)<[^>]*>", " ")), F.lit(""))
    return own if limit is None else F.substring(own, 1, limit)
