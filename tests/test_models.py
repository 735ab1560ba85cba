from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import models as M

HTML = """<html lang="en" data-x='1' lang="de"><head><title>A  title</title><meta name="description" content="D"><script type="application/ld+json">{"@type": "Product"}</script></head>
<body class="one two"><header><nav><a href="/b">B</a><a href="https://other.example/">O</a></nav></header><div class="row"><h1>H <b>one</b></h1><h2>Two</h2><div class="col"><p>Text</p><img src="/i.png" alt="i"></div></div>
<div style="display: none">Not <i>shown</i></div><form action="/go"><input name="q" required></form><aside class="widget"><h3>W</h3></aside></body></html>"""


def captured(spark):
    rows = [("s", 0, "http://a.example/x", "http://a.example/x/y", 200, 0, HTML), ("s", 1, "http://a.example/", "http://a.example/", 404, 1, "<p>small</p>"), ("t", 0, "http://b.example/", "http://b.example/", None, 0, None), ("t", 1, "http://b.example/e", "http://b.example/e", 200, 1, "")]
    return spark.createDataFrame(rows, "site string, place long, source_url string, url string, status_code int, depth int, html string")


def same(one, two):
    plain = lambda df: sorted(repr(r.asDict(recursive=True)) for r in df.select(sorted(df.columns)).collect())
    return plain(one) == plain(two)


def test_tables_to_models_to_tables_is_the_identity(spark, tmp_path):
    tables = {name: df.cache() for name, df in M.page_tables(captured(spark)).items()}
    assert {name: df.count() for name, df in tables.items()}["blocks"] > 5 and all(df.count() for df in tables.values())
    M.write_models(M.nested(tables), str(tmp_path / "models"))
    back = M.tables_of(M.read_models(spark, str(tmp_path / "models")))
    assert set(back) == set(tables)
    for name in tables:
        assert back[name].schema.fieldNames() == tables[name].schema.fieldNames() and same(back[name], tables[name]), name


def test_what_a_model_holds(spark):
    m = {r.url: r for r in M.nested(M.page_tables(captured(spark))).collect()}["http://a.example/x/y"]
    assert (m.slug, m.title, m.description, m.indexability, m.body_classes, m.hidden_text, m.structured_types) == ("x-y", "A title", "D", "indexable", ["one", "two"], ["Not shown"], ["Product"])
    assert m.html_attributes == {"lang": "de", "data-x": "1"} and m.head_html.startswith("<title>")
    assert [(h.level, h.text) for h in m.headings] == [(1, "H one"), (2, "Two"), (3, "W")]
    assert [(x.kind, x.url) for x in m.links] == [("external", "https://other.example/"), ("internal", "http://a.example/b")]
    assert [s.type for s in m.sections] and any(b.media for b in m.blocks) and m.forms[0].required and m.widgets[0].title == "W"


def test_gathering_models_moves_nothing_and_reads_no_element_again(spark):
    plan = M.nested(M.page_tables(captured(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "Exchange" not in plan
    assert "RowFrame, 1, unboundedfollowing" not in plan and "RowFrame, unboundedpreceding$(), -1" in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def older(spark):
    """The same page as versions 1 and 2 stored it."""
    new = M.nested(M.page_tables(captured(spark))).where("url = 'http://a.example/x/y'")
    level = lambda i: F.transform(F.filter("headings", lambda x: x["level"] == i), lambda x: x["text"])
    first = new.select("site", "place", "url", "source_url", "status_code", "title", "description", F.struct(*[level(i).alias(f"h{i}") for i in (1, 2, 3)]).alias("headings"), F.transform(F.array_sort("links", lambda a, b: a["n"] - b["n"]), lambda x: x["url"]).alias("links"), F.transform("images", lambda x: x["src"]).alias("images"), "visible_text")
    names = ("node", "place", "block_id", "type", "tag", "text", "media")
    flat = lambda b: F.struct(*[b[n].alias(n) for n in names])
    children = lambda b: F.transform(F.filter("blocks", lambda c: (c["level"] == 2) & (c["parent"] == b["node"])), flat)
    blocks = lambda s: F.transform(F.filter("blocks", lambda b: (b["level"] == 1) & (b["section"] == s["section"])), lambda b: F.struct(*[b[n].alias(n) for n in names], children(b).alias("children")))
    root = lambda s: F.get(F.transform(F.filter("blocks", lambda b: (b["level"] == 1) & (b["section"] == s["section"])), lambda b: b["parent"]), 0)
    layout = F.transform("sections", lambda s: F.struct(*[s[n].alias(n) for n in ("section", "section_id", "type", "tag", "columns", "elements")], root(s).alias("node"), blocks(s).alias("blocks")))
    second = new.select(*[f.name for f in T.StructType.fromDDL(M.PAGE)], *[n for n in M.PARTS if n not in ("sections", "blocks")], layout.alias("layout"))
    return new, first, second


def test_older_models_are_read(spark, tmp_path):
    new, first, second = older(spark)
    at = str(tmp_path / "models")
    first.withColumn("site", F.lit("one")).write.partitionBy("site").parquet(f"{at}/version=1")
    second.withColumn("site", F.lit("two")).write.partitionBy("site").parquet(f"{at}/version=2")
    M.write_models(new, at)
    rows = {r.site: r for r in M.read_models(spark, at).collect()}
    assert {s: r.version for s, r in rows.items()} == {"one": 1, "two": 2, "s": 3}
    assert rows["two"].sections == rows["s"].sections and rows["two"].blocks == [b for b in rows["s"].blocks if b.level < 3] and rows["two"].forms == rows["s"].forms
    assert rows["one"].headings == rows["s"].headings and rows["one"].links == rows["s"].links and [i.src for i in rows["one"].images] == ["/i.png"] and rows["one"].blocks == [] and rows["one"].slug == "x-y"
    pages, menus = M.restored(M.read_models(spark, at))
    assert {r.title for r in pages.collect()} == {"A title"} and pages.count() == 3 and menus.count() == 3


def test_restoring_fills_what_a_page_lacks(spark):
    pages, menus = M.restored(M.nested(M.page_tables(captured(spark))))
    row = {r.source_url: r for r in pages.collect()}["http://b.example/"]
    assert (row.title, row.meta_description, row.canonical, row.robots, row.content, row.h1, row.media_refs, row.html_ref) == ("home", "", "http://b.example/", "", "", [], [], "../../raw/pages/home.html")
    assert [(r.site, r.n, r.slug) for r in menus.orderBy("site", "n").collect()] == [("s", 1, "x-y"), ("s", 2, "home"), ("t", 1, "home"), ("t", 2, "e")]


def test_unknown_versions_and_missing_models_fail(spark, tmp_path):
    (tmp_path / "models" / "version=9").mkdir(parents=True)
    with pytest.raises(ValueError, match="unknown"):
        M.read_models(spark, str(tmp_path / "models"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no page models"):
        M.read_models(spark, str(tmp_path / "none"))
