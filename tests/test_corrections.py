from __future__ import annotations

from siltstone.operators import corrections as C


def results(spark, rows):
    names = "site string, place long, slug string, height_mismatch boolean, height_ratio double, content_mismatch boolean, structure_mismatch boolean, responsive_mismatch boolean, header_present boolean, footer_present boolean, broken_images int, style_sheets int, missing_fonts int"
    return spark.createDataFrame(rows, f"{names}, viewports {C.VIEWPORTS}")


FINE = dict(height_mismatch=False, height_ratio=1.0, content_mismatch=False, structure_mismatch=False, responsive_mismatch=None, header_present=True, footer_present=True, broken_images=0, style_sheets=1, missing_fonts=0, viewports=None)


def row(site, place, slug, **changes):
    return (site, place, slug, *(FINE | changes).values())


def test_plan_of_safe_corrections(spark):
    view = lambda **x: ("wide", *(x.get(d) for d in C.DIMENSIONS))
    pages = results(
        spark,
        [
            row("a", 0, "home", height_mismatch=True, height_ratio=1.2, header_present=None, viewports=[view(text=False, positions=True), ("narrow", None, True, None, None, None, None)]),
            row("a", 1, None, content_mismatch=True, broken_images=2, style_sheets=None, missing_fonts=1, footer_present=False),
            row("b", 0, "home", viewports=[view(structure=False)]),
            row("c", 0, "home", height_mismatch=True, height_ratio=1.5),
            row("d", 0, "home", height_mismatch=True, height_ratio=1.1),
        ],
    )
    clicks = spark.createDataFrame([("a", 0, "div.cmplz-banner.shade", "Buy"), ("a", 1, "div.shade", "Buy"), ("c", 0, "div", "x"), ("d", 0, None, None)], "site string, place long, blocker string, text string")
    room = '<div class="gap wide">&nbsp;</div>'
    templates = spark.createDataFrame([("a", f"<p>x</p>{room}"), ("c", '<div class="gap">text</div>'), ("d", room)], "site string, html string")
    got = {r.site: r for r in C.plan(pages, clicks, templates).collect()}
    assert got["a"].applied == ["remove-empty-spacers", "disable-technical-click-blockers"] and got["a"].technical == ["cmplz-banner"]
    assert got["a"].unresolved == ["text:home:wide", "header:home", "content:unknown", "footer:unknown", "media:unknown", "css:unknown", "fonts:unknown", "blocked-click:Buy"]
    assert (got["b"].applied, got["b"].unresolved) == (["repair-native-commerce-responsive-layout"], ["structure:home:wide"])
    assert (got["c"].applied, got["c"].unresolved, got["c"].status) == ([], [], "no-safe-correction-needed") and got["d"].status == "no-safe-correction-needed"
    assert C.plan(pages.limit(0), clicks, templates).count() == 0


def test_iterations_end(spark):
    rows = [("a", 1, ["r"], ["x", "y"], "s"), ("a", 2, ["r"], ["y", "x"], "s"), ("a", 3, [], [], "s"), ("b", 1, ["r"], ["x"], "s"), ("b", 2, ["r"], [], "s"), ("c", 1, [], ["x"], "s")] + [("d", i, ["r"], [str(i)], "s") for i in range(1, 8)]
    plans = spark.createDataFrame(rows, "site string, iteration int, applied array<string>, unresolved array<string>, status string")
    assert {r.site: (r.iteration, r.ends) for r in C.settled_iterations(plans).collect()} == {"a": (2, True), "b": (2, False), "c": (1, True), "d": (5, True)}
