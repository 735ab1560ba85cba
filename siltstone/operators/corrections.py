"""Safe corrections of rebuilt sites: what a comparison in a browser leaves unresolved, and which repairs its evidence allows.

Missing content is never guessed and no real part is hidden: such causes stay
unresolved.  Every finding is a row; the plan of a site is an aggregate of its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is compared at each size of a screen, what tells a technical blocker, how much taller a page may be, and elements that only hold room.
DIMENSIONS = ("text", "images", "structure", "typography", "positions", "interactions")
TECHNICAL = r"(?i)^(?:[a-z0-9_-]*)(?:preloader|loader|consent|cookie|cmplz)(?:[a-z0-9_-]*)$"
TALLER = 1.1
SPACER = r"""(?i)<(div|section)\b(?=[^>]*\bclass=(['"])[^'"]*\b(?:spacer|empty|gap)\b[^'"]*\2)[^>]*>\s*(?:&nbsp;)?\s*</\1>"""
REPAIRS = ("remove-empty-spacers", "disable-technical-click-blockers", "repair-native-commerce-responsive-layout")


def is_true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def unresolved_of(results: DataFrame) -> DataFrame:
    """Findings (site, place, n, what) on pages that stay unresolved, in order.

    ``results``: site, place, slug, content_mismatch, structure_mismatch, responsive_mismatch, header_present, footer_present, broken_images,
    style_sheets, missing_fonts, and viewports, a list of (viewport and whether each of DIMENSIONS passed; null if it was not compared).
    """
    slug = F.coalesce("slug", F.lit("unknown"))
    said = lambda kind, when: F.when(when, F.concat(F.lit(f"{kind}:"), slug))
    first = [said(kind, is_true(f"{kind}_mismatch")) for kind in ("content", "structure", "responsive")]
    at = lambda v, d: F.when(F.coalesce(~v[d], F.lit(False)), F.concat_ws(":", F.lit(d), slug, F.coalesce(v["viewport"], F.lit("unknown"))))
    each = F.flatten(F.transform(F.coalesce("viewports", F.array().cast(VIEWPORTS)), lambda v: F.array(*[at(v, d) for d in DIMENSIONS])))
    rest = [
        said("header", ~is_true("header_present")), said("footer", ~is_true("footer_present")), said("media", F.col("broken_images") > 0),
        said("css", F.coalesce("style_sheets", F.lit(0)) < 1), said("fonts", F.col("missing_fonts") > 0),
    ]
    every = F.array_compact(F.concat(F.array(*first), each, F.array(*rest)))
    return results.select("site", "place", F.posexplode(every).alias("n", "what"))


VIEWPORTS = f"array<struct<viewport: string, {', '.join(f'{d}: boolean' for d in DIMENSIONS)}>>"


def blockers_of(clicks: DataFrame) -> DataFrame:
    """For each class of what blocked a click (site, place, blocker: tag and classes by dots, text): whether it is technical, and what stays unresolved if not."""
    classes = F.slice(F.split(F.coalesce("blocker", F.lit("")), r"\."), 2, 10_000)
    own = clicks.select("site", "place", F.posexplode(classes).alias("n", "class_name"), F.coalesce("text", "blocker", F.lit("")).alias("text"))
    technical = F.col("class_name").rlike(TECHNICAL)
    return own.select("site", "place", "n", "class_name", technical.alias("technical"), F.when(~technical, F.concat(F.lit("blocked-click:"), "text")).alias("what"))


def without_spacers(html: Column) -> Column:
    """A template without empty elements whose own class says that they only hold room."""
    return F.regexp_replace(html, SPACER, "")


def plan(results: DataFrame, clicks: DataFrame, templates: DataFrame) -> DataFrame:
    """A row for each site of ``results``: applied repairs, what stays unresolved in order of its finding, technical classes, status.

    ``templates`` (site, html) are only changed where a page is too tall for its original.
    """
    blocked = blockers_of(clicks)
    found = unresolved_of(results).select("site", F.lit(0).alias("part"), "place", "n", "what").unionByName(blocked.where("what is not null").select("site", F.lit(1).alias("part"), "place", "n", "what"))
    once = found.groupBy("site", "what").agg(F.min(F.struct("part", "place", "n")).alias("at"))
    left = once.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "what"))), lambda x: x["what"]).alias("unresolved"))
    technical = blocked.where("technical").groupBy("site").agg(F.array_sort(F.collect_set("class_name")).alias("technical"))
    failed = lambda v: reduce(Column.__or__, [F.coalesce(~v[d], F.lit(False)) for d in ("positions", "structure")])
    pages = results.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.bool_or(is_true("height_mismatch") & F.coalesce(F.col("height_ratio") > TALLER, F.lit(False))).alias("tall"),
        F.bool_or(F.exists(F.coalesce("viewports", F.array().cast(VIEWPORTS)), failed)).alias("shifted"),
    )
    spaced = templates.groupBy("site").agg(F.bool_or(without_spacers(F.col("html")) != F.col("html")).alias("spaced"))
    own = reduce(lambda a, b: a.join(b, "site", "left"), [pages, left, technical, spaced])
    none = F.array().cast("array<string>")
    own = own.withColumns({c: F.coalesce(c, none) for c in ("unresolved", "technical")})
    wanted = (F.col("tall") & F.coalesce("spaced", F.lit(False)), F.size("technical") > 0, F.col("shifted"))
    own = own.withColumn("applied", F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in zip(wanted, REPAIRS, strict=True)])))
    status = F.when(F.size("applied") > 0, F.lit("corrected-revalidation-required")).when(F.size("unresolved") > 0, F.lit("needs-review")).otherwise(F.lit("no-safe-correction-needed"))
    return own.select("site", "pages", "applied", "unresolved", "technical", status.alias("status"))


def settled_iterations(plans: DataFrame, most: int = 5) -> DataFrame:
    """Of the plans of each site by iteration (site, iteration, applied, unresolved, status) where it ends: nothing was applied, the same stays unresolved as before, or ``most`` is reached."""
    by = Window.partitionBy("site").orderBy("iteration")
    same = F.coalesce(F.array_sort("unresolved") == F.array_sort(F.lag("unresolved").over(by)), F.lit(False)) & F.coalesce(F.col("applied") == F.lag("applied").over(by), F.lit(False))
    ends = (F.size("applied") == 0) | same | (F.col("iteration") >= most)
    own = plans.withColumn("ends", ends)
    first_end_else_last = Window.partitionBy("site").orderBy(F.desc("ends"), F.when(F.col("ends"), F.col("iteration")).otherwise(-F.col("iteration")))
    return own.withColumn("n", F.row_number().over(first_end_else_last)).where("n = 1").drop("n")
