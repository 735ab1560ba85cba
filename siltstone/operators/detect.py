"""What a site is built with: platforms, themes' frameworks, page builders and plugins, by the signs in its pages.

One pass over each page finds the literal starts of all signs at once with an
automaton; only where one stands is its pattern tried.  Pages are not joined
to one text: the first page of a site that shows a sign tells evidence and version.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kind, name, signs (each a literal start, maybe with a pattern behind it), confidence; in their order.
RULES = (
    ("platform", "WordPress", r"wp-content|wp-includes|WordPress\s*([0-9.]+)?", 90),
    ("platform", "Shopify", r"cdn\.shopify\.com|Shopify(?:\.theme|Analytics)?", 90),
    ("platform", "PrestaShop", r'prestashop|\/modules\/ps_|content="PrestaShop', 85),
    ("platform", "Magento", r"Magento|mage\/|data-mage-init", 85),
    ("platform", "WooCommerce", r"woocommerce|wc-cart|wc-block", 80),
    ("platform", "Webflow", r"webflow\.js|data-wf-page", 80),
    ("platform", "Wix", r"wixstatic\.com|X-Wix", 75),
    ("platform", "Squarespace", r"squarespace|static1\.squarespace\.com", 75),
    ("platform", "Next.js", r"__NEXT_DATA__", 80),
    ("platform", "Nuxt", r"__NUXT__", 80),
    ("platform", "Astro", r"astro-island|data-astro", 70),
    ("framework", "Bootstrap", r"bootstrap(?:\.min)?\.css", 70),
    ("framework", "Tailwind", r"tailwind|tw-", 60),
    ("framework", "Genesis", r"genesis", 70),
    ("framework", "Astra", r"astra", 70),
    ("framework", "Kadence", r"kadence", 70),
    ("framework", "GeneratePress", r"generatepress", 70),
    ("builder", "Elementor", r"elementor(?:-pro)?|data-elementor", 95),
    ("builder", "Bricks", r"bricks-|data-bricks", 90),
    ("builder", "Divi", r"et_pb_|Divi", 90),
    ("builder", "Beaver Builder", r"fl-builder|fl-row|fl-module", 85),
    ("builder", "Oxygen", r"ct-section|oxygen", 85),
    ("builder", "WPBakery", r"wpb_|vc_row|js_composer", 85),
    ("builder", "Kadence", r"kt-|kadence", 75),
    ("builder", "Spectra", r"uagb-|spectra", 75),
    ("builder", "GenerateBlocks", r"gb-container|generateblocks", 75),
    ("builder", "Gutenberg", r"wp-block-|block-library", 80),
    ("plugin", "WooCommerce", r"woocommerce|wc-block|wc-cart", 90),
    ("plugin", "RankMath", r"rank-math|rankmath", 85),
    ("plugin", "Yoast", r"yoast|wpseo", 85),
    ("plugin", "Elementor", r"elementor", 90),
    ("plugin", "ACF", r"acf-|advanced-custom-fields", 75),
    ("plugin", "WPML", r"wpml|sitepress", 75),
    ("plugin", "Polylang", r"polylang|pll_", 75),
    ("plugin", "Contact Form 7", r"wpcf7|contact-form-7", 85),
    ("plugin", "WPForms", r"wpforms", 85),
    ("plugin", "Fluent Forms", r"fluentform|fluent-forms", 85),
    ("plugin", "CookieYes", r"cookieyes|cky-", 80),
    ("plugin", "Complianz", r"complianz|cmplz-", 80),
    ("theme", "name", r"""wp-content\/themes\/([^/"')?]+)""", 80),
    ("theme", "block theme markers", r"wp-block-|theme\.json|global-styles-inline-css", 65),
)
KINDS = ("platform", "framework", "builder", "plugin", "theme")
GENERATOR = r"""(?is)<meta\b(?=[^>]*\bname\s*=\s*["']?generator\b)[^>]*\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def literal(sign: str) -> str:
    """The text with which every match of a sign begins."""
    start = re.match(r"(?:\\[./]|[^\\(\[*+?])+", sign)[0]
    return start.replace("\\", "").lower()


@cache
def automaton():
    """Over all literal starts; each tells which signs begin so: rule, place among its signs, pattern."""
    import ahocorasick

    found: dict[str, list[tuple[int, int, re.Pattern]]] = {}
    for rule, (_, _, pattern, _) in enumerate(RULES):
        for place, sign in enumerate(pattern.split("|") if "(?:" not in pattern else re.split(r"\|(?![^(]*\))", pattern)):
            found.setdefault(literal(sign), []).append((rule, place, re.compile(sign, re.I | re.A)))
    machine = ahocorasick.Automaton()
    for start, signs in found.items():
        machine.add_word(start, (len(start), signs))
    machine.make_automaton()
    return machine


_SMALL = {c: c + 32 for c in range(65, 91)}


def signs_of(text: str) -> dict[int, tuple[str, str | None]]:
    """Of each rule that a text shows: the first match, and what its group holds."""
    best: dict[int, tuple[int, int, re.Match]] = {}
    for end, (size, signs) in automaton().iter(text.translate(_SMALL)):
        start = end - size + 1
        for rule, place, pattern in signs:
            if (rule not in best or (start, place) < best[rule][:2]) and (match := pattern.match(text, start)):
                best[rule] = (start, place, match)
    return {rule: (m[0], m[1] if m.re.groups else None) for rule, (_, _, m) in best.items()}


def signs(pages: DataFrame) -> DataFrame:
    """A row for each sign on each page (site, place, html): order of the rule, kind, name, confidence, evidence, version.

    Platforms are looked for in the name of the page's generator first.
    """
    kinds = dict(pages.dtypes)
    schema = pa.schema([("order", pa.int32()), ("evidence", pa.string()), ("version", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, told = [], []
            for r, (html, made_by) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = signs_of(html or "")
                if made_by:
                    found |= {k: v for k, v in signs_of(f"{made_by}\n").items() if RULES[k][0] == "platform"}
                rows += [r] * len(found)
                told += [(k, *v) for k, v in sorted(found.items())]
            if told:
                own = [pa.array(x, f.type) for x, f in zip(zip(*told, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *own], ["site", "place", *schema.names])

    made_by = F.coalesce(F.nullif(F.regexp_extract("html", GENERATOR, 1), F.lit("")), F.nullif(F.regexp_extract("html", GENERATOR, 2), F.lit("")))
    own = pages.select("site", "place", F.col("html").cast("string"), made_by.alias("made_by"))
    found = own.mapInArrow(run, f"site {kinds['site']}, place {kinds['place']}, `order` int, evidence string, version string")
    of = lambda i: F.element_at(F.array(*[F.lit(rule[i]) for rule in RULES]), F.col("order") + 1)
    return found.select("site", "place", "order", of(0).alias("kind"), of(1).alias("name"), of(3).alias("confidence"), F.trim(F.regexp_replace("evidence", r"\s+", " ")).alias("evidence"), "version")


def first_signs(pages: DataFrame) -> DataFrame:
    """Of each site and rule the sign on the first page that shows it."""
    of_site = signs(pages).groupBy("site", "order", "kind", "name", "confidence").agg(F.min(F.struct("place", "evidence", "version")).alias("x"))
    return of_site.select("site", "order", "kind", "name", "confidence", F.col("x.place").alias("first_page"), "x.evidence", "x.version")


def detections(pages: DataFrame) -> DataFrame:
    """What each site (site, place, html) is built with, ranked within its kind: surest first, in the rules' order among equals."""
    rank = F.row_number().over(Window.partitionBy("site", "kind").orderBy(F.desc("confidence"), "order"))
    return first_signs(pages).where("kind <> 'theme'").withColumn("rank", rank).drop("order")


def themes(pages: DataFrame) -> DataFrame:
    """The theme of each site: its name, framework (the first rule that fits), type, confidence and evidence."""
    found = first_signs(pages).where(F.col("kind").isin("theme", "framework"))
    is_name, is_block = F.col("name") == "name", F.col("name") == "block theme markers"
    framework: Column = F.min(F.when(F.col("kind") == "framework", F.struct("order", "name")))["name"]
    none = pages.select("site").distinct().select("site", *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "site"])
    every = found.unionByName(none).groupBy("site").agg(
        F.max(F.when((F.col("kind") == "theme") & is_name, F.col("version"))).alias("active"), F.max(F.when((F.col("kind") == "theme") & is_name, F.col("evidence"))).alias("shown"),
        framework.alias("framework"), F.coalesce(F.bool_or((F.col("kind") == "theme") & is_block), F.lit(False)).alias("block"),
    )
    named = F.col("active").isNotNull()
    kind = F.when(F.col("block"), F.lit("block")).when(named, F.lit("classic")).otherwise(F.lit("unknown"))
    evidence = F.array_distinct(F.array_compact(F.array("shown", "framework", F.when(F.col("block"), F.lit("block theme markers")))))
    return every.select("site", "active", "framework", kind.alias("type"), F.when(named, 80).when(F.col("block"), 65).otherwise(20).alias("confidence"), evidence.alias("evidence"))
