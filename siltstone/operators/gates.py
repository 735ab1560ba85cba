"""Evidence gates: what is missing fails, and a gate tells which of its checks did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEWPORTS = ("mobile", "tablet", "laptop", "desktop")


def failures(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that do not hold; one that is null does not."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def _report(name: str, field: str, kind: str = "string") -> Column:
    """A field of a site's report, null where report or field is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(F.try_element_at("reports", F.lit(name))), f"$.{field}", kind)


def passes(name: str) -> Column:
    return _report(name, "status") == "pass"


def none_of(name: str, *fields: str) -> Column:
    """The report is there and lists nothing under these fields."""
    out = F.try_element_at("reports", F.lit(name)).isNotNull()
    for field in fields:
        held = F.try_variant_get(F.try_parse_json(F.try_element_at("reports", F.lit(name))), f"$.{field}[0]", "variant")
        out &= held.isNull()
    return out


def quality_gate(sites: DataFrame) -> DataFrame:
    """Sites (site, reports: map of report name to JSON text) with the failed checks and a status."""
    expected = F.coalesce(_report("runtime", "commerce.expectedProducts", "int"), F.lit(0))
    flag = lambda name, field: _report(name, field, "boolean")
    number = lambda name, field: F.coalesce(_report(name, field, "int"), F.lit(0))
    purchase = passes("commerce")
    for field in ("bridgeDetected", "addToCartSucceeded", "cartHasItem", "checkoutReachable", "checkoutUsable", "testOrderCreated"):
        purchase &= F.coalesce(flag("commerce", field), F.lit(False))
    purchase &= (number("commerce", "addToCartButtonsChecked") >= 1) & (number("commerce", "addToCartButtonsUsable") == number("commerce", "addToCartButtonsChecked"))
    for field in ("cartBaselineAvailable", "checkoutBaselineAvailable", "cartBaselinePass", "checkoutBaselinePass"):
        purchase &= F.coalesce(flag("commerce_visual", field), F.lit(False))
    purchase &= F.coalesce(passes("commerce_visual"), F.lit(False))
    editable = passes("editable") & flag("editable", "allPagesEditable") & flag("editable", "visualEditorAvailable") & (number("editable", "pageCount") >= 1)
    editable &= (number("editable", "expectedPageCount") == number("editable", "pageCount")) & (number("editable", "blockCount") >= number("editable", "pageCount"))
    checks = [
        ("pages", none_of("pages", "missingPages", "emptyPages", "failedPages", "duplicatedPages", "incorrectSlugs", "incorrectTemplates", "missingLanguages", "missingParentRelations")),
        ("critical-resources", none_of("resources", "missingCriticalResources")),
        ("capture-integrity", flag("capture_integrity", "complete")),
        ("source-capture", passes("source_capture")),
        *[(name, passes(report)) for name, report in (("runtime", "runtime"), ("visual", "visual"), ("css-runtime", "css_runtime"), ("interactions", "interactions"), ("content-order", "content_order"))],
        ("forms", none_of("forms", "missingForms", "brokenForms")),
        ("content", none_of("content", "missingTextBlocks", "missingMedia", "missingComponents")),
        ("original-links", F.coalesce(_report("urls", "originalInternalDomainReferences", "int"), F.lit(1)) == 0),
        ("network-locality", passes("local_dependencies")),
        ("offline-runtime", passes("network") & none_of("network", "forbiddenExternalRequests")),
        ("commerce-purchase-flow", (expected == 0) | purchase),
        ("editable-pages", editable),
        ("cookie-consent", _report("consent", "status").isin("pass", "not_applicable")),
        ("header-footer-navigation", passes("globals") & flag("globals", "headerPresent") & flag("globals", "footerPresent") & flag("globals", "navigationPresent")),
    ]
    return sites.withColumn("failures", failures(checks)).withColumn("status", F.when(F.size("failures") == 0, F.lit("ready")).otherwise(F.lit("needs_review")))


def missing_viewports(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """Pages and required viewports without a capture; the list of viewports has a fixed size."""
    wanted = pages.select("site", "slug", F.explode(F.array(*[F.lit(v) for v in VIEWPORTS])).alias("viewport"))
    return wanted.join(captures.select("site", "slug", "viewport"), ["site", "slug", "viewport"], "left_anti")


def acceptance(sites: DataFrame, pages: DataFrame, captures: DataFrame) -> DataFrame:
    """The verdict on each site from its gate, its pages' visual results (site, slug, status) and captures."""
    visual = pages.groupBy("site").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") == "pass").alias("approved"))
    gaps = missing_viewports(pages, captures).groupBy("site").agg(F.count(F.lit(1)).alias("gaps"))
    gate = quality_gate(sites)
    number = lambda name, field: F.coalesce(_report(name, field, "int"), F.lit(0))
    own = gate.join(visual, "site", "left").join(gaps, "site", "left").fillna(0, ["seen", "approved", "gaps"])
    expected = F.greatest(number("editable", "expectedPageCount"), number("pages", "expectedPages"), F.col("seen"))
    own = own.withColumn("expected", expected)
    whole = (F.col("expected") > 0) & (F.col("seen") == F.col("expected"))
    capture, source = _report("capture_integrity", "complete", "boolean"), passes("source_capture")
    checks = [
        ("capture-integrity", capture),
        ("source-capture", source),
        ("quality-gate", F.col("status") == "ready"),
        ("all-pages-validated", whole),
        ("all-pages-approved", (F.col("expected") > 0) & (F.col("approved") == F.col("expected"))),
        ("all-required-viewports", whole & (F.col("gaps") == 0)),
        ("runtime", passes("runtime")),
        ("editability", passes("editable") & _report("editable", "allPagesEditable", "boolean") & _report("editable", "visualEditorAvailable", "boolean")),
    ]
    own = own.withColumn("failed_checks", failures(checks))
    has = lambda name: F.array_contains("failed_checks", name)
    there = lambda name: F.try_element_at("reports", F.lit(name)).isNotNull()
    verdict = (
        F.when((there("capture_integrity") & has("capture-integrity")) | (there("source_capture") & has("source-capture")), F.lit("blocked_by_source"))
        .when(~there("visual") | ~there("runtime"), F.lit("blocked_by_environment"))
        .when(has("all-pages-validated") | has("all-pages-approved") | has("all-required-viewports"), F.lit("needs_partial_reconstruction"))
        .when(F.size("failed_checks") == 0, F.lit("ready"))
        .otherwise(F.lit("needs_manual_review"))
    )
    return own.select("site", "failures", "failed_checks", "expected", "approved", verdict.alias("verdict"))


def missing_artifacts(files: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Required paths that a capture lacks (errors), and optional ones (warnings)."""
    wanted = files.select("site").distinct().select("site", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(s).alias("severity")) for s, own in (("error", required), ("warning", optional)) for p in own])).alias("x"))
    return wanted.select("site", "x.path", "x.severity").join(files.select("site", "path"), ["site", "path"], "left_anti")


def missing_resources(referenced: DataFrame, downloaded: DataFrame) -> DataFrame:
    return referenced.select("url").distinct().join(downloaded.select("url"), "url", "left_anti")


def page_audit(expected: DataFrame, built: DataFrame) -> DataFrame:
    """Expected pages (slug) that are missing or empty: nothing, or under 64 bytes without visible text."""
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "(?s)<[^>]*>", " "), r"\s+", " "))
    empty = (F.col("raw") == "") | ((F.octet_length("raw") < 64) & (text == ""))
    own = expected.select("slug").join(built.select("slug", "raw"), "slug", "left")
    return own.withColumn("issue", F.when(F.col("raw").isNull(), F.lit("missing")).when(empty, F.lit("empty"))).where("issue is not null").select("slug", "issue")


def health(projects: DataFrame, now_ms: Column, stale_s: int = 300) -> Column:
    """completed, failed, stale or active."""
    return (
        F.when(F.col("status").isin("completed", "ready"), F.lit("completed"))
        .when(F.col("status") == "failed", F.lit("failed"))
        .when(now_ms - F.col("updated_at") > stale_s * 1000, F.lit("stale"))
        .otherwise(F.lit("active"))
    )


def sequence_similarity(expected: Column, seen: Column) -> Column:
    """Share of expected items that are met in order, each seen item used once, taking the first that fits."""
    step = lambda s, x: F.when(F.get(expected, s) == x, s + 1).otherwise(s)
    matched = F.aggregate(seen, F.lit(0), step)
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(matched / F.size(expected))
