from __future__ import annotations

import csv
import glob
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import rules
from siltstone.sources import readers, sinks
from siltstone.sources import workbooks as W


def test_json_and_archives(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"a": {"b": 3}}')
    (tmp_path / "j/b.json").write_text("{bad")
    rows = {r.path.rsplit("/", 1)[-1]: r.b for r in readers.json_documents(spark, str(tmp_path / "j")).select("path", F.try_variant_get("document", "$.a.b", "int").alias("b")).collect()}
    assert rows == {"a.json": 3, "b.json": None}
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("p/a.html", "<p>")
        z.writestr("../evil.html", "x")
        z.writestr("i.png", b"\0")
    assert [(r.name, r.text) for r in readers.archive_members(spark, str(tmp_path / "c.zip")).collect()] == [("p/a.html", "<p>")]


def test_broken_archives_have_a_status(spark, tmp_path):
    (tmp_path / "none.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as archive:
        archive.writestr("a.txt", "fine")
        archive.writestr("b.txt", "spoilt text")
    data = (tmp_path / "two.zip").read_bytes()
    (tmp_path / "two.zip").write_bytes(data.replace(b"spoilt text", b"Spoilt text", 1))
    got = {(r.archive.rsplit("/", 1)[-1], r.name): (r.text, bool(r.problem)) for r in readers.archive_members(spark, str(tmp_path)).collect()}
    assert got == {("none.zip", None): (None, True), ("two.zip", "a.txt"): ("fine", False), ("two.zip", "b.txt"): (None, True)}


def test_workbooks_of_businesses(spark, tmp_path):
    rows = [("Café  Uno", " https://www.A.com:8080/es/ ", "1", "x\r\ny & <z>"), ("Cafe Uno", "https://b.com", None, None), ("Again", "http://a.com/es", "2", ""), (None, "https://c.com", "3", ""), ("No site", "www.d.com", "", ""), ("日本", "https://e.com", "", "\x01ok")]
    W.write_workbooks(spark.createDataFrame(rows, "`Nombre ` string, `PÁGINA   Web` string, `Teléfono` string, `Dirección` string").coalesce(1), str(tmp_path / "books"))
    (tmp_path / "books" / "broken.xlsx").write_bytes(b"PK nothing")
    told = W.workbook_rows(spark, str(tmp_path / "books")).cache()
    assert [(r.sheet, r.row, bool(r.problem)) for r in told.where("problem is not null").collect()] == [(None, None, True)] and told.count() == 8
    got = [(r.name, r.website, r.phone, r.address, r.slug, [(x.sheet, x.row) for x in r.rows]) for r in W.workbook_businesses(told).orderBy("place").collect()]
    assert got == [
        ("Café  Uno", "https://www.A.com:8080/es/", "1", "x\r\ny & <z>", "cafe-uno", [("rows", 2), ("rows", 4)]),
        ("Cafe Uno", "https://b.com", "", "", "cafe-uno-2", [("rows", 3)]),
        ("日本", "https://e.com", "", "ok", "tienda", [("rows", 7)]),
    ]
    W.write_workbooks(spark.createDataFrame([(str(i), str(i)) for i in range(7)], "a string, b string").coalesce(1), str(tmp_path / "parts"), 3)
    assert W.workbook_rows(spark, str(tmp_path / "parts")).count() == 10 and W.workbook_businesses(W.workbook_rows(spark, str(tmp_path / "parts"))).count() == 0


def test_references_shared_texts_and_gaps():
    import io

    main, linked = W.MAIN.strip("{}"), W.LINKED.strip("{").split("}")[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{linked}"><sheets><sheet name="S" sheetId="1" r:id="a"/><sheet name="T" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/missing.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="AB1"><v>5</v></c></row><row r="4"><c t="s"><v>0</v></c><c><v>2.5</v></c></row></sheetData></worksheet>')
    rows = list(W.sheet_rows(memoryview(out.getvalue())))
    assert rows[0] == (0, "S", 1, ["one", *[None] * 26, "5"], None) and rows[1] == (0, "S", 4, ["zero", "2.5"], None)
    assert rows[2][:4] == (1, "T", None, None) and "missing" in rows[2][4]


def test_businesses_manifest_and_settings(spark):
    rows = [(1, "Café Uno", "https://www.a.com/"), (2, "Again", "http://A.com"), (3, "cafe uno", "https://b.com"), (4, "x", "ftp://c"), (5, None, "https://d.com")]
    got = readers.businesses(spark.createDataFrame(rows, "place int, name string, website string")).orderBy("place").collect()
    assert [(r.place, r.slug) for r in got] == [(1, "cafe-uno"), (3, "cafe-uno-2"), (5, "tienda")]
    manifest = spark.createDataFrame([("s", "home", None)], "site string, slug string, url string")
    models = spark.createDataFrame([("s", "home", "T", "u"), ("t", "x", "X", "v")], "site string, slug string, title string, model_url string")
    found = spark.createDataFrame([("s", "other"), ("t", "x")], "site string, slug string")
    assert sorted((r.site, r.slug, r.url) for r in readers.manifest_pages(manifest, models, found).collect()) == [("s", "home", "u"), ("t", "x", "v")]
    assert readers.settings({"a": 1, "b": "x"}, {"a": "true", "c": "2.5"}, {"b": "7"}) == {"a": True, "b": 7, "c": 2.5}


def test_jobs(spark):
    base = spark.createDataFrame([("j1", "running", 5, "r"), ("j2", "completed", 9, None), ("j3", "queued", 7, None)], "id string, status string, created_at long, seo_report_json string")
    views = readers.jobs(base)
    assert [r.id for r in views["newest"].collect()] == ["j2", "j3", "j1"] and [r.id for r in views["open"].collect()] == ["j1", "j3"]
    patch = spark.createDataFrame([("j1", "failed")], "id string, status string")
    got = {r.id: (r.status, r.created_at, r.seo_report_json) for r in readers.patched(base, patch, "id").collect()}
    assert got == {"j1": ("failed", 5, "r"), "j2": ("completed", 9, None), "j3": ("queued", 7, None)}
    assert readers.with_columns(base, {"error": "string", "id": "string"}).columns[-1] == "error"
    ids = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("123e4567",), (None,)], "i string")
    assert [r[0] for r in ids.select(readers.is_uuid("i")).collect()] == [True, False, False]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("https://x.com/a", '<title>A "quoted", title</title>'), ("https://x.com/b", None)], "url string, html string")
    judged = rules.page_issues(rules.features(pages))
    status = sinks.write_all(spark, {"csv": lambda: sinks.pages_csv(judged, str(tmp_path / "csv")), "json": lambda: sinks.pages_json(judged.withColumn("html", F.lit("x")), str(tmp_path / "json")), "bad": lambda: 1 / 0})
    assert [(r.name, r.ok) for r in status.collect()] == [("csv", True), ("json", True), ("bad", False)]
    rows = [r for part in glob.glob(str(tmp_path / "csv/part-*")) for r in csv.DictReader(open(part))]
    assert {r["title"] for r in rows} == {'A "quoted", title', ""} and all(" | " in r["issues"] for r in rows)
    assert "html" not in spark.read.json(str(tmp_path / "json")).columns
    assert sinks.public(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]
    phases = spark.createDataFrame([("p", "completed", None), ("q", "completed", "x")], "name string, status string, digest string").withColumn("digest", F.when(F.col("name") == "p", F.sha2(F.lit("in"), 256)).otherwise(F.col("digest")))
    inputs = spark.createDataFrame([("p", "in"), ("q", "in")], "name string, content string")
    assert {r.name: r.skip for r in sinks.checkpointed(phases, inputs).collect()} == {"p": True, "q": False}
    index = sinks.site_index(spark.createDataFrame([(i, f"https://x.com/{i}", "t") for i in range(30)], "place int, url string, title string"))
    assert index.count() == 20
