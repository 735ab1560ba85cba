"""Crawl frontier: admission of candidate links, first-wins deduplication, capped patterns, and breadth-first closure.

Order matters in all of these: candidates carry their place, so a result does
not depend on how rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.checkpoints import cut
from siltstone.functions import urls as U
from siltstone.operators.joins import join_by
from siltstone.operators.ranks import numbered

PATTERN_CAP = 25


def first_wins(rows: DataFrame, key: str, order: str, mark: str | None = None) -> DataFrame:
    """The first row of each key in order; or all rows, with ``mark`` on the first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    if mark:
        return rows.withColumn(mark, n == 1)
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by aggregation."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def numbered_slugs(rows: DataFrame, slug: str, order: str, out: str = "numbered") -> DataFrame:
    """slug, slug-2, slug-3 ... in order."""
    n = F.col("_n")
    return numbered(rows, [order], [slug], "_n").withColumn(out, F.when(n == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), n.cast("string")))).drop("_n")


def content_fingerprint(title: Column, canonical: Column, links: Column) -> Column:
    own = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    return F.concat(own(title), F.lit("|"), F.lower(F.trim(F.coalesce(canonical, F.lit("")))), F.lit("|"), links.cast("string"))


def content_duplicates(pages: DataFrame, order: str) -> DataFrame:
    """Pages whose content (title, canonical, n_links) an earlier page has; these are not published and their links not followed."""
    own = pages.withColumn("fingerprint", content_fingerprint(F.col("title"), F.col("canonical"), F.col("n_links")))
    return first_wins(own, "fingerprint", order, mark="published")


def capped(rows: DataFrame, key: str, order: str, cap: int = PATTERN_CAP) -> DataFrame:
    """At most ``cap`` rows of each key; Spark keeps only so many of a key before the shuffle."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def admission(candidates: DataFrame, allowed: list[str], accepted: DataFrame | None = None, robots: DataFrame | None = None, cap: int = PATTERN_CAP) -> DataFrame:
    """Each candidate (seq, url) with the reason why it is rejected, null if it is admitted.

    Reasons in order: invalid, asset, duplicate, equivalent, pattern_cap,
    domain, robots.  Only admitted links count as seen, and only they count
    towards the cap; links rejected by domain or robots hide no later ones.
    ``seq`` tells candidates apart.  No class or pattern is gathered: its first
    members and its full place are aggregated and joined back, and of a pattern
    at most ``cap`` rows are ranked.
    """
    own = candidates.withColumn("normalized", U.normalized("url"))
    own = own.withColumn("canonical", U.canonical("normalized")).withColumn("equivalence", U.equivalence_key("normalized")).withColumn("pattern", U.pattern_key("normalized"))
    # reasons that do not depend on other candidates
    outside = ~F.coalesce(U.same_site("normalized", allowed), F.lit(False)) if allowed else F.lit(False)
    own = own.withColumn("alone", F.when(F.col("normalized").isNull(), F.lit("invalid")).when(U.is_asset("normalized"), F.lit("asset")))
    own = own.withColumn("late", F.when(outside, F.lit("domain")))
    if robots is not None:
        barred = blocked_by_robots(own.where("alone is null and late is null").select("seq", "normalized"), robots)
        own = own.join(barred.withColumn("barred", F.lit(True)), "seq", "left").withColumn("late", F.coalesce("late", F.when(F.col("barred"), F.lit("robots")))).drop("barred")
    if accepted is not None:
        before = accepted.select(U.canonical("url").alias("canonical"), U.equivalence_key("url").alias("equivalence"), U.pattern_key("url").alias("pattern"))
        known, alike = (before.select(F.col(c).alias(c)).distinct().withColumn(f"old_{c}", F.lit(True)) for c in ("canonical", "equivalence"))
        counted = before.groupBy("pattern").agg(F.count(F.lit(1)).alias("old_n"))
        own = own.join(known, "canonical", "left").join(alike, "equivalence", "left").join(counted, "pattern", "left")
    else:
        own = own.withColumns({"old_canonical": F.lit(None).cast("boolean"), "old_equivalence": F.lit(None).cast("boolean"), "old_n": F.lit(None).cast("long")})
    eligible = F.col("alone").isNull() & F.col("late").isNull() & F.col("old_canonical").isNull() & F.col("old_equivalence").isNull()
    # A class of equivalent links tries its members in order until one is admitted; a try fails only where its
    # pattern is full by then.  Tries and failures only grow from round to round, so this ends; most often at once.
    own = own.withColumn("eligible", eligible).withColumn("failed", F.lit(False))
    own = cut(own.withColumn("room", cap - F.coalesce("old_n", F.lit(0))))  # addresses are read once
    while True:
        first = own.where("eligible and not failed").groupBy("equivalence").agg(F.min("seq").alias("first"))
        tried = own.join(first, "equivalence", "left").withColumn("tries", F.coalesce(F.col("first") == F.col("seq"), F.lit(False))).drop("first")
        # the place at which a pattern is full: its room-th try, failed ones counted
        ranked = tried.where("tries or failed").select("pattern", "seq", "room").withColumn("n", F.row_number().over(Window.partitionBy("pattern").orderBy("seq")))
        full = ranked.where((F.col("n") <= cap) & (F.col("n") == F.col("room"))).select("pattern", F.col("seq").alias("full_at"))
        within = (F.col("room") > 0) & F.coalesce(F.col("seq") <= F.col("full_at"), F.lit(True))
        own = cut(tried.join(full, "pattern", "left").withColumn("admitted", F.col("tries") & within).withColumn("more", F.col("tries") & ~within).drop("full_at"))
        if not own.where("more").limit(1).count():
            break
        # what follows in the same class with the same pattern fails as well
        full_from = own.where("more").groupBy("equivalence", "pattern").agg(F.min("seq").alias("full_from"))
        own = own.drop("tries", "admitted", "more").join(full_from, ["equivalence", "pattern"], "left")
        own = own.withColumn("failed", F.col("failed") | F.coalesce(F.col("eligible") & (F.col("full_from") <= F.col("seq")), F.lit(False))).drop("full_from")
    taken = own.where("admitted")
    last = taken.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_taken"), F.max("seq").alias("last"))
    own = own.join(last, "pattern", "left")
    for key in ("canonical", "equivalence"):
        own = own.join(taken.groupBy(key).agg(F.min("seq").alias(f"seen_{key}")), key, "left")
    own = own.withColumn("full_before", (F.col("room") <= 0) | F.coalesce((F.col("n_taken") >= F.col("room")) & (F.col("last") < F.col("seq")), F.lit(False)))
    seen = lambda key: F.coalesce(F.col(f"seen_{key}") < F.col("seq"), F.lit(False))
    reason = (
        F.when(F.col("alone").isNotNull(), F.col("alone"))
        .when(F.col("old_canonical").isNotNull() | seen("canonical"), F.lit("duplicate"))
        .when(F.col("old_equivalence").isNotNull() | seen("equivalence"), F.lit("equivalent"))
        .when(F.col("full_before"), F.lit("pattern_cap"))
        .otherwise(F.col("late"))
    )
    return own.withColumn("reject_reason", reason).drop("alone", "late", "eligible", "failed", "tries", "admitted", "more", "full_before", "room", "n_taken", "last", "seen_canonical", "seen_equivalence", "old_canonical", "old_equivalence", "old_n")


def prioritised(tasks: DataFrame, order: str = "seq") -> DataFrame:
    """Tasks (url) by priority of their kind, first come first among equals."""
    own = tasks.withColumn("kind", U.kind("url")).withColumn("priority", U.priority("kind"))
    return own.orderBy(F.desc("priority"), order)


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """Allow and disallow prefixes of robots files (origin, body) for an agent: origin, allow, prefix.

    Each user-agent line begins a new group; a value ends at a further colon.
    """
    lines = files.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    field = F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1)))
    value = F.trim(F.regexp_extract("line", r"^[^:]+:([^:]*)", 1))
    lines = lines.withColumn("field", field).withColumn("value", value)
    group = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("origin").orderBy("n"))
    own = lines.withColumn("agent", group).where((F.col("agent") == "*") | (F.lower("agent") == agent.lower()))
    return own.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select("origin", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix"))


def robots_index(rules: DataFrame) -> DataFrame:
    """Rules (origin, allow, prefix) without those that a shorter rule of their kind and origin covers, with the prefix's ``size``.

    So a path meets at most one rule of each kind.
    """
    own = rules.select("origin", "allow", "prefix").distinct()
    shorter = own.select("origin", "allow", "prefix", F.explode(F.sequence(F.lit(1), F.greatest(F.length("prefix") - 1, F.lit(1)))).alias("n")).where("n < length(prefix)")
    shorter = shorter.withColumn("covers", F.expr("substring(prefix, 1, n)"))
    covered = shorter.join(own.select("origin", "allow", F.col("prefix").alias("covers")), ["origin", "allow", "covers"], "left_semi").select("origin", "allow", "prefix").distinct()
    return own.join(covered, ["origin", "allow", "prefix"], "left_anti").withColumn("size", F.length("prefix"))


def robots_matches(links: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules (allow, prefix) that the links (origin, path, and others) meet, by an index of prefixes.

    A path is looked up by equality, once for each length that its origin's
    rules have, so no link is compared with the rules of its origin one by one.  A path
    meets at most one rule of a kind; links without origin or path meet none.
    """
    index = cut(robots_index(rules))
    sizes = index.groupBy("origin").agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # as many as the longest prefix has letters at most
    tried = join_by(links, sizes, ["origin"])
    tried = tried.withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("path")))).withColumn("prefix", F.expr("substring(path, 1, size)"))
    kinds = index.groupBy("origin", "prefix").agg(F.collect_set("allow").alias("kinds"))
    return join_by(tried.drop("sizes", "size"), kinds, ["origin", "prefix"]).withColumn("allow", F.explode("kinds")).drop("kinds")


def blocked_by_robots(links: DataFrame, rules: DataFrame) -> DataFrame:
    """``seq`` of links (seq, normalized) that the rules of their origin bar; any allowing prefix wins."""
    own = links.select("seq", U.origin("normalized").alias("origin"), U.path("normalized").alias("path"))
    met = robots_matches(own, rules)
    return met.groupBy("seq").agg(F.bool_or("allow").alias("allowed")).where("not allowed").select("seq")


def breadth_first(start: DataFrame, edges: DataFrame, max_pages: int, max_depth: int = 50) -> DataFrame:
    """Pages reached from ``start`` (url) over ``edges`` (source, place, target), by level, with depth and order of discovery.

    Each level is one join and one anti-join; it ends when nothing new is
    found or ``max_pages`` are.  Levels are numbered range by range, and the
    lineage is cut at each.
    """
    level = cut(numbered(start.select("url"), ["url"], out="found").select("url", F.lit(0).alias("depth"), "found"))
    every, total = level, level.count()
    for depth in range(1, max_depth + 1):
        if total >= max_pages:
            break
        steps = level.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url"), F.struct("found", "place").alias("by"))
        new = steps.groupBy("url").agg(F.min("by").alias("by")).join(every.select("url"), "url", "left_anti")
        # a level that would pass the limit is cut in order of discovery
        level = cut(numbered(new, ["by"]).where(F.col("n") <= max_pages - total).select("url", F.lit(depth).alias("depth"), (F.lit(total) + F.col("n")).cast("long").alias("found")))
        size = level.count()
        if not size:
            break
        total += size
        every = every.unionByName(level)
    return every


def dependency_closure(start: DataFrame, edges: DataFrame, passes: int = 5, limit: int = 20_000) -> DataFrame:
    """Resources reached from ``start`` (url) over ``edges`` (source, target) in a bounded number of passes."""
    every = cut(start.select("url").distinct())
    for _ in range(passes):
        more = every.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct().join(every, "url", "left_anti")
        grown = cut(every.union(more))
        size = grown.count()
        if size == every.count():
            break
        every = grown
        if size >= limit:
            return every.orderBy("url").limit(limit)
    return every


def source_counters(decided: DataFrame, source: str = "source_url") -> DataFrame:
    """Per source page how many candidates were admitted, were duplicates, or were discarded."""
    reason = F.col("reject_reason")
    return decided.groupBy(source).agg(
        F.count_if(reason.isNull()).alias("discovered"),
        F.count_if(reason.isin("duplicate", "equivalent", "pattern_cap")).alias("duplicates"),
        F.count_if(reason.isin("invalid", "domain", "robots")).alias("discarded"),
        F.count_if(reason == "asset").alias("assets"),
    )


def duplicate_ratio(duplicates: Column, discovered: Column) -> Column:
    return F.coalesce(F.try_divide(duplicates, duplicates + discovered), F.lit(0.0))


def pending(discovered: DataFrame, visited: DataFrame) -> DataFrame:
    """What is known and not visited, without assets."""
    return discovered.where(~U.is_asset("url")).select("url").distinct().join(visited.select("url"), "url", "left_anti")
