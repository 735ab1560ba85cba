from __future__ import annotations

import glob
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest

from siltstone.llm import warc as A
from siltstone.llm.oracles import ORACLES
from siltstone.llm.queries import QUERIES


def brute(rows):
    """rows: (page_id, url, html); what the contract says of each."""
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, b in payloads:
        last[b] = max(last.get(b, p), p, key=lambda x: (x is not None, x))
    out, told = [], set()
    for p, b in payloads:
        original = len(b) < 1000 or (p == last[b] and b not in told)
        if p == last[b]:
            told.add(b)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if original else "revisit", None if original else last[b]))
    return sorted(out, key=str)


def pages(seed, n):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("<p>é 日\r\n:WARC/1.1 Content-Length") for _ in range(k))
    shared = [make(k) for k in (300, 1200, 5000)] + ["a" * 1000, "a" * 999, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40]
    rows = [(i, rng.choice([f"http://h{i % 9}.example/{i}?q=a b", None, "", "x y\nz é", "filedesc://odd"]), rng.choice([*shared, make(rng.randrange(3000)), None])) for i in range(n)]
    return rows + [(None, "u", shared[1]), (None, None, "b" * 2000), (None, None, "b" * 2000), (5000, "u", shared[2]), (5000, "u", shared[2]), (-7, "u", "c" * 1500), (-3, "u", "c" * 1500)]


@pytest.mark.parametrize("broadcast", [A.BROADCAST, 0])
def test_pages_through_both_archives_match_brute_force(spark, broadcast):
    rows = pages(1, 300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, place int, refers string").repartition(5)
    assert sorted(map(tuple, A.archived(df, broadcast=broadcast).collect()), key=str) == brute(rows)


def test_query_matches_its_sql_and_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
        want = sorted(base.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op11_warc']})").fetchall(), key=str)
    assert sorted(map(tuple, QUERIES["op11_warc"](spark, folder).collect()), key=str) == want
    assert A.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


V1 = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
V2 = b"filedesc://new.arc 0.0.0.0 19970101 text/plain 200 - - 0 new.arc 122\n2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"


def listed(content):
    return [(v, h.get("URL"), b, p) for _, v, h, b, p in A.arc_records(memoryview(content))]


def test_headers_of_both_versions_and_declared_lengths():
    one = V1[: V1.index(b"1 0")] + b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
    one = one.replace(b" 76\n", b" %d\n" % len(one.split(b"\n", 1)[1])) + b"\n"
    one += b"http://a.example/x y 1.2.3.4 19960923142104 text/html 12\nHTTP/1.0 200\n\ndns:a.example 1.2.3.4 19960923 text/dns 5\nab\n\nc\n"
    got = listed(one)
    assert [x[0] for x in got] == [1, 1, 1] and [x[1] for x in got][1:] == ["http://a.example/x y", "dns:a.example"]
    assert got[1][2] == b"HTTP/1.0 200" and got[2][2] == b"ab\n\nc" and not any(x[3] for x in got)
    head, _, block = V2.partition(b"\n")
    two = head.replace(b" 122", b" %d" % len(block)) + b"\n" + block + b"\nhttp://b.example/ 9.9.9.9 19970102030405 image/gif 200 - - 150 new.arc 4\nGIF8\n"
    got = listed(two)
    assert [(x[0], x[1]) for x in got] == [(2, "filedesc://new.arc"), (2, "http://b.example/")] and got[1][2] == b"GIF8"
    # a line of a version-2 archive is no header in a version-1 archive
    assert listed(one + b"\nnonsense\nmore nonsense\nhttp://c.example/ 1.1.1.1 19990101000000 text/plain 3\nxyz\n")[3:] == [(1, None, b"nonsense\n", "no header"), (1, "http://c.example/", b"xyz", None)]
    assert listed(one + b"\nhttp://d.example/ 1.1.1.1 19990101000000 text/plain 30\nshort")[-1] == (1, "http://d.example/", b"short", "cut short")
    packed = gzip.compress(one) + gzip.compress(b"") + gzip.compress(b"\nhttp://e.example/ 1.1.1.1 19990101000000 text/plain 3\nxyz\n")
    assert [x[1] for x in listed(packed)][-1] == "http://e.example/"
    assert "unreadable" in listed(packed[:-9])[-1][3] and "unreadable" in listed(packed[:60] + b"\xff" * 40)[-1][3]
    assert listed(b"") == [] and listed(b"\x1f\x8b")[0][3].startswith("unreadable")


def test_dates_and_types():
    assert [A.iso_date(x) for x in ("19960923142103", "19970101", "1999", "20001301000000")] == ["1996-09-23T14:21:03Z", "1997-01-01T00:00:00Z", "1999-01-01T00:00:00Z", None]
    assert A.http_parts(b"HTTP/1.0 200 OK\nA: b\n\nxy\n\nz") == (b"HTTP/1.0 200 OK\nA: b\n\n", b"xy\n\nz")
    assert A.http_parts(b"HTTP/1.0 200 OK") == (b"HTTP/1.0 200 OK", b"") and A.http_parts(b"v=1") is None
    assert A.http_field(b"HTTP/1.1 200\r\nx-page-id:  7 \r\nB: 2\r\n\r\n", b"X-Page-Id") == "7"


def test_foreign_archives_get_equivalent_records(spark, tmp_path):
    folder = tmp_path / "arc"
    folder.mkdir()
    reply = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + b"q" * 1200
    body = b"1 1 Someone\nURL IP-address Archive-date Content-type Archive-length\n<xml/>\n"
    data = b"filedesc://old.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(body) + body
    for url, date, block in ((b"http://a.example/", b"20010203040507", reply), (b"http://b.example/", b"20010203040508", reply), (b"dns:a.example", b"20010203", b"20010203\na.example. 60 IN A 1.2.3.4\n"), (b"http://c.example/", b"20019903040508", b"no reply")):
        data += b"\n" + url + b" 1.2.3.4 " + date + b" text/dns %d\n" % len(block) + block
    (folder / "old.arc").write_bytes(data + b"\njunk\nhttp://z.example/ 1.2.3.4 20010203040509 text/html 99\nHTTP/1.1 200 OK\r\n\r\nabc")
    records = A.read_arc(spark, str(folder)).cache()
    assert {r.problem for r in records.collect()} == {None, "no header", "cut short"}
    A.convert(records, A.originals(records), str(tmp_path / "warc"))
    got = {r.url: r for r in A.read_warc(spark, str(tmp_path / "warc")).where("record_type <> 'warcinfo'").collect()}
    assert {u: r.record_type for u, r in got.items()} == {"http://a.example/": "revisit", "http://b.example/": "response", "dns:a.example": "resource", "http://c.example/": "resource", "http://z.example/": "response"}
    assert got["http://a.example/"].refers == got["http://b.example/"].record_id and got["http://a.example/"].digest == hashlib.sha1(b"q" * 1200).hexdigest()
    assert got["dns:a.example"].date == "2001-02-03T00:00:00Z" and got["http://c.example/"].date == "1970-01-01T00:00:00Z" and not any(r.problem for r in got.values())
    info = A.read_warc(spark, str(tmp_path / "warc")).where("record_type = 'warcinfo'").collect()
    assert len(info) >= 2 and any(b"arc-block: 1 1 Someone" in r.block for r in info)
    # any reader of gzip members finds the same records
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/warc/part-*"))
    assert text.count(b"WARC-Record-ID: ") == len(got) + len(info) and b"WARC-Truncated: unspecified" in text
    for f in glob.glob(f"{tmp_path}/warc/part-*"):
        unpack = zlib.decompressobj(31)
        assert unpack.decompress(open(f, "rb").read()).count(b"WARC/1.1\r\nWARC-Type") == 1


def test_identifiers_do_not_depend_on_the_run(spark, tmp_path):
    rows = pages(2, 30)
    A.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), str(tmp_path / "arc"))
    one, two = (sorted(r.record_id for r in A.read_arc(spark, str(tmp_path / "arc")).collect()) for _ in range(2))
    assert one == two and len(set(one)) == len(one)
    versions = {r.version for r in A.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert versions == {1, 2}


def test_altered_payload_is_told(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    row = {"kind": "response", "refers": None, "refers_url": None, "refers_date": None, "archive": "a", "version": 1, "record_id": "urn:uuid:1", "date": None, "url": "u", "ip": "-", "problem": None, "type": "", "digest": hashlib.sha1(b"abd").hexdigest()}
    (tmp_path / "one.warc.gz").write_bytes(A.warc_record(row, block))
    (tmp_path / "two.warc").write_bytes(b"WARC/1.0\r\nwarc-type: resource\r\nX: a\r\n b\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\nx")
    got = {(r.archive, r.place): r.problem for r in A.read_warc(spark, str(tmp_path)).collect()}
    assert got == {("one.warc.gz", 0): "digest", ("two.warc", 0): None, ("two.warc", 1): "cut short"}
