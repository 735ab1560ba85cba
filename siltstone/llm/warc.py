"""Legacy archives to WARC: ARC files are parsed by version and declared lengths, and get equivalent WARC records.

1. ``write_arc`` writes pages as ARC archives of version 1 and 2 in turn, each
   of about ARCHIVE_BYTES before compression, a gzip member for each record;
   no shuffle.  Archives from elsewhere are read alike.
2. ``read_arc`` reads the version block at the start of each archive, takes
   the names of the header fields from it, and cuts the records by their
   declared lengths.
3. ``originals`` finds payloads that several records have; ``convert`` gives
   each record a WARC type (an HTTP reply is a response, or a revisit of the
   original with the same payload; anything else a resource; a version block
   warcinfo), an identifier made from archive and place, an ISO timestamp,
   and digests of block and payload.  The table of repeated payloads is
   broadcast up to BROADCAST rows; beyond that it is joined by hash, and only
   its hot keys are broadcast.
4. ``read_warc`` reads WARC archives back and checks their digests.

Archives are files of Spark's own text writer, one row of bytes each, so its
commit protocol holds when executors are lost, on any file system.  An archive is
read by one task; a record and an archive's compressed bytes must fit its memory.

Edge cases: null html is an empty payload; a null page_id is smaller than any
other, and written as no header; a null or empty url becomes urn:page:<id>, and bytes in it that
are no visible ASCII are percent-encoded.  Of rows that repeat the largest
page_id of a payload, one is the response.  Other columns are ignored; an empty table gives no rows.
A record cut short, a line that is no header, and a broken gzip member give rows with a
``problem``; after such a line reading goes on at the next header.
"""

from __future__ import annotations

import base64
import calendar
import gzip
import hashlib
import io
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import HOT, LEAST, join_hot, settle, shared_folder

ARCHIVE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
LEVEL = 3
BROADCAST = 1 << 17
#: Payloads under so many bytes are written again each time.
REVISIT_FROM = 1000
LINE = 1 << 16

#: The fields of a record's header line by version of the archive, as its version block names them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
BROKEN = (EOFError, OSError, zlib.error)

ARC = "archive string, place long, version int, url string, ip string, date string, kind string, type string, page_id long, payload_bytes long, digest string, fingerprint binary, record_id string, block binary, problem string"
WARC = "archive string, place long, record_id string, record_type string, url string, date string, refers string, page_id long, payload_bytes long, digest string, block binary, problem string"


def member(*parts: bytes) -> bytes:
    """A gzip member of its own."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([*map(c.compress, parts), c.flush()])


def opened(content: memoryview) -> io.BufferedIOBase:
    """The bytes of an archive, unpacked as they are read."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if bytes(content[:2]) == b"\x1f\x8b" else raw


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Head (with the empty line) and payload of an HTTP reply; None if it is no such reply."""
    if not block.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", block)
    at = end.end() if end else len(block)
    return block[:at], block[at:]


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return found[1].decode("latin-1") if found else None


def whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None


def iso_date(digits: str) -> str | None:
    """The date of an ARC header (4 to 14 digits) as WARC has it; None if it is no date."""
    full = digits + "00000101000000"[len(digits) :]
    try:
        return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(calendar.timegm(time.strptime(full, "%Y%m%d%H%M%S"))))
    except ValueError:
        return None


def named_id(*parts: object) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def arc_header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """The fields of a header line; the address is what is left of the others.  None if it is no header."""
    parts = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
    found = dict(zip(fields, parts, strict=True)) if len(parts) == len(fields) else {}
    fine = found.get("URL") and re.fullmatch("[0-9]{1,18}", found["Archive-length"]) and re.fullmatch("[0-9]{4,14}", found["Archive-date"])
    return found if fine else None


def declared(block: bytes) -> tuple[int, list[str]]:
    """Version of an archive and its header fields, from its version block."""
    first, _, rest = block.partition(b"\n")
    number = re.match(rb"\s*([0-9]+)", first)
    version = int(number[1]) if number else 1
    names = rest.partition(b"\n")[0].decode("latin-1").split()
    usable = names[:1] == ["URL"] and names[-1:] == ["Archive-length"] and "Archive-date" in names
    return version, names if usable else FIELDS.get(version, FIELDS[1])


def arc_records(content: memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
    """Place, version, header, block and problem of each record of an archive."""
    source, version, fields, place, lost = opened(content), 1, FIELDS[1], 0, False
    try:
        while line := source.readline(LINE):
            if not line.strip():
                continue
            first = place == 0 and line.startswith(b"filedesc:")
            header = arc_header(line, FIELDS[2] if first and line.count(b" ") >= len(FIELDS[2]) - 1 else fields)
            if header is None:
                if not lost:
                    yield place, version, {}, line, "no header"
                    place += 1
                lost = True
                continue
            lost = False
            block = source.read(int(header["Archive-length"]))
            if first:
                version, fields = declared(block)
            yield place, version, header, block, None if len(block) == int(header["Archive-length"]) else "cut short"
            place += 1
    except BROKEN as problem:
        yield place, version, {}, b"", f"unreadable: {problem}"[:200]


def warc_records(content: memoryview) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Place, header (names in lower case), block and problem of each record of an archive."""
    source, place, lost = opened(content), 0, False
    try:
        while line := source.readline(LINE):
            if not line.strip():
                continue
            header: dict[str, str] = {}
            if line.startswith(b"WARC/"):
                name = ""
                while (line := source.readline(LINE)).strip():
                    text = line.decode("utf-8", "replace").strip("\r\n")
                    if text[:1] in " \t" and name:
                        header[name] += " " + text.strip()
                    else:
                        name, _, value = text.partition(":")
                        name = name.strip().lower()
                        header[name] = value.strip()
            length = whole(header.get("content-length"))
            if length is None or length < 0:
                if not lost:
                    yield place, {}, b"", "no header"
                    place += 1
                lost = True
                continue
            lost = False
            block = source.read(length)
            yield place, header, block, None if len(block) == length else "cut short"
            place += 1
    except BROKEN as problem:
        yield place, {}, b"", f"unreadable: {problem}"[:200]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_at: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some thousand rows, or of about BATCH_BYTES in the column ``size_at``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[size_at] or b"")
        if size > BATCH_BYTES or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_arc(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """The records (ARC) of all archives in ``folder``, packed or not; ``block`` is null without ``blocks``."""
    schema = _schema(ARC)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive = path.rsplit("/", 1)[-1]
                for place, version, header, block, problem in arc_records(memoryview(content.as_buffer())):
                    parts = http_parts(block)
                    kind = "warcinfo" if place == 0 and header.get("URL", "").startswith("filedesc:") else "response" if parts else "resource"
                    head, payload = parts or (b"", block)
                    page = whole(http_field(head, b"X-Page-Id"))
                    date = iso_date(header["Archive-date"]) if header else None
                    yield (
                        archive, place, version, header.get("URL"), header.get("IP-address"), date, kind, header.get("Content-type"), page, len(payload),
                        hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).digest(), named_id(archive, place), block if blocks else None, problem,
                    )

    return _files(spark, folder).mapInArrow(lambda batches: _batches(rows(batches), schema, 13), ARC)


def read_warc(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """The records (WARC) of all archives in ``folder``; what a revisit says of its payload is from its headers."""
    schema = _schema(WARC)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive = path.rsplit("/", 1)[-1]
                for place, header, block, problem in warc_records(memoryview(content.as_buffer())):
                    kind = header.get("warc-type")
                    head, payload = http_parts(block) or (b"", block)
                    told = re.fullmatch(r"sha1:([A-Z2-7]{32})", header.get("warc-payload-digest", ""))
                    digest = base64.b32decode(told[1]).hex() if told else None
                    if kind == "revisit":
                        size = whole(http_field(head, b"Content-Length"))
                    else:
                        size, own = len(payload), hashlib.sha1(payload).hexdigest()
                        problem = problem or ("digest" if digest not in (None, own) else None)
                        digest = own
                    bare = lambda name: header.get(name, "").strip("<>") or None  # noqa: B023, E731
                    yield (
                        archive, place, bare("warc-record-id"), kind, header.get("warc-target-uri"), header.get("warc-date"), bare("warc-refers-to"),
                        whole(http_field(head, b"X-Page-Id")), size, digest, block if blocks else None, problem,
                    )

    return _files(spark, folder).mapInArrow(lambda batches: _batches(rows(batches), schema, 10), WARC)


def _written(values: DataFrame, folder: str) -> None:
    """Each row of bytes as a file of its own, with an empty gzip member at its end."""
    text = values.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(folder)


class Archive:
    """Gathers gzip members until they are about ARCHIVE_BYTES before packing; ``start`` gives the first member of the archive with a number."""

    def __init__(self, start: Callable[[int], bytes]) -> None:
        self.start, self.number, self.held, self.offset, self.size = start, 0, [], 0, 0

    def open(self) -> None:
        if not self.held:
            self.add(self.start(self.number), 0)

    def add(self, packed: bytes, length: int) -> None:
        self.held.append(packed)
        self.offset += len(packed)
        self.size += length

    def close(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """The archive as one row, if it has a member and ``least`` bytes."""
        if self.held and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(self.held)], pa.binary())], ["value"])
            self.number, self.held, self.offset, self.size = self.number + 1, [], 0, 0


def write_arc(pages: DataFrame, folder: str, first_second: int = 1_700_000_000, versions: tuple[int, ...] = (1, 2)) -> None:
    """``pages`` (page_id, url, html) as archives in ``folder``, the versions in turn; a page's date is page_id seconds after ``first_second``."""

    def stamp(seconds: int) -> str:
        return time.strftime("%Y%m%d%H%M%S", time.gmtime(first_second + seconds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = lambda number: versions[(task + number) % len(versions)]
        name = lambda number: f"pages-{task:06d}-{number:04d}.arc.gz"

        def line(number: int, url: bytes, date: str, kind: str, offset: int, length: int) -> bytes:
            more = f" 200 - - {offset} {name(number)}" if version(number) == 2 else ""
            return url + f" 127.0.0.1 {date} {kind}{more} {length}\n".encode()

        def start(number: int) -> bytes:
            told = f"{version(number)} 0 siltstone\n{' '.join(FIELDS[version(number)])}\n".encode()
            return member(line(number, f"filedesc://{name(number)}".encode(), stamp(0), "text/plain", 0, len(told)), told, b"\n")

        archive = Archive(start)
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_buffer() if html.is_valid else b""
                own = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%bContent-Length: %d\r\n\r\n" % (own, len(payload))
                address = re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{'' if page is None else page}").encode())
                archive.open()
                size = len(head) + len(payload)
                archive.add(member(line(archive.number, address, stamp((page or 0) % (1 << 28)), "text/html", archive.offset, size), head, payload, b"\n"), size)
                yield from archive.close(ARCHIVE_BYTES)
        yield from archive.close()

    _written(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary")).mapInArrow(run, "value binary"), folder)


def originals(records: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """fingerprint, often, refers, refers_url and refers_date of each payload of ``least`` bytes or more that several responses have: of that with the largest page_id."""
    some = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least) & F.col("problem").isNull())
    best = some.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("often"), F.max(F.struct("page_id", "date", "record_id", "url")).alias("best")).where("often > 1")
    return best.select("fingerprint", "often", F.col("best.record_id").alias("refers"), F.col("best.url").alias("refers_url"), F.col("best.date").alias("refers_date"))


def _referred(records: DataFrame, repeated: DataFrame, least: int, broadcast: int) -> DataFrame:
    """``records`` with refers, refers_url and refers_date, null where they are originals."""
    eligible = (F.col("kind") == "response") & (F.col("payload_bytes") >= least) & F.col("problem").isNull()
    # other records get a key that no payload has, so that short payloads that many records share are spread
    records = records.withColumn("fingerprint", F.when(eligible, F.col("fingerprint")).otherwise(F.unhex(F.sha1("record_id"))))
    distinct, rows = repeated.agg(F.count(F.lit(1)), F.sum("often")).first()
    table = repeated.drop("often")
    if distinct <= broadcast:
        joined = records.join(F.broadcast(table), "fingerprint", "left")
    else:
        is_hot = F.col("often") > max(rows // HOT, LEAST)
        hot, cold = F.broadcast(repeated.where(is_hot).drop("often")), repeated.where(~is_hot).drop("often")
        joined = records.join(hot, "fingerprint").unionByName(records.join(F.broadcast(hot.select("fingerprint")), "fingerprint", "left_anti").join(cold.hint("merge"), "fingerprint", "left"))
    itself = F.col("refers") == F.col("record_id")
    return joined.withColumns({name: F.when(~itself, F.col(name)) for name in ("refers_url", "refers_date")} | {"refers": F.when(~itself, F.col("refers"))})


def warc_record(row: dict, block: bytes) -> bytes:
    """The WARC record of a row of ARC records with its reference."""
    kind = "revisit" if row["refers"] else row["kind"]
    parts = http_parts(block)
    if kind == "revisit":
        block = parts[0]
    if kind == "warcinfo":
        told, content = f"software: siltstone\r\nformat: WARC/1.1\r\nconverted-from: {row['archive']}\r\narc-version: {row['version']}\r\n", "application/warc-fields"
        block = told.encode() + b"".join(b"arc-block: %b\r\n" % x.strip() for x in block.split(b"\n") if x.strip())
    else:
        content = "application/http; msgtype=response" if parts else row["type"]
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row["date"] or "1970-01-01T00:00:00Z"),
        ("WARC-Filename", row["archive"]) if kind == "warcinfo" else ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"] if row["ip"] not in ("0.0.0.0", "-") and kind != "warcinfo" else None),
        ("WARC-Warcinfo-ID", f"<{named_id(row['archive'], 0)}>" if kind != "warcinfo" else None),
        ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", f"<{row['refers']}>" if kind == "revisit" else None),
        ("WARC-Refers-To-Target-URI", row["refers_url"]),
        ("WARC-Refers-To-Date", row["refers_date"]),
        ("WARC-Truncated", "unspecified" if row["problem"] else None),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).hexdigest())}"),
        ("WARC-Payload-Digest", f"sha1:{base32(row['digest'])}" if kind != "warcinfo" else None),
        ("Content-Type", content),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return member(f"WARC/1.1\r\n{head}\r\n".encode(), block, b"\r\n\r\n")


def convert(records: DataFrame, repeated: DataFrame, folder: str, least: int = REVISIT_FROM, broadcast: int = BROADCAST) -> None:
    """ARC records (with blocks) as WARC archives in ``folder``; lines that were no header, and unreadable rests, are left out.

    Each archive starts with a warcinfo record of its own; ``repeated`` as from originals().
    """
    names = [x.split()[0] for x in ARC.split(", ")]
    small = [n for n in names if n not in ("fingerprint", "block")] + ["refers", "refers_url", "refers_date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def start(number: int) -> bytes:
            name = f"converted-{task:06d}-{number:04d}.warc.gz"
            return warc_record({"kind": "warcinfo", "refers": None, "refers_url": None, "refers_date": None, "archive": name, "version": "-", "record_id": named_id(name, task), "date": None, "url": None, "ip": None, "problem": None}, b"")

        archive = Archive(start)
        for batch in batches:
            for row, block in zip(batch.select(small).to_pylist(), batch.column("block"), strict=True):
                archive.open()
                archive.add(warc_record(row, block.as_py()), len(block.as_buffer()))
                yield from archive.close(ARCHIVE_BYTES)
        yield from archive.close()

    whole_ones = records.where("url is not null")
    _written(_referred(whole_ones, repeated, least, broadcast).select(*small, "block").mapInArrow(run, "value binary"), folder)


def _gone(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archived(pages: DataFrame, least: int = REVISIT_FROM, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of ``pages`` as their WARC archives have them: written as ARC, converted, read back."""
    spark = pages.sparkSession
    arc, warc = (f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("arc", "warc"))
    write_arc(pages, arc)
    index = settle(read_arc(spark, arc, blocks=False).drop("block"), "arc_index")
    convert(read_arc(spark, arc), settle(originals(index, least), "originals"), warc, least, broadcast)
    back = settle(read_warc(spark, warc, blocks=False).drop("block"), "warc_index")
    if problem := back.select("archive", "place", "problem").where("problem is not null").first() or index.select("archive", "place", "problem").where("problem is not null").first():
        raise ValueError(f"{problem.archive}, record {problem.place}: {problem.problem}")
    _gone(spark, arc, warc)
    return page_records(back)


def page_records(records: DataFrame) -> DataFrame:
    """The responses and revisits among WARC records; refers_to is the page_id of the response that a revisit names."""
    result = ("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type")
    revisits = records.where("record_type = 'revisit'")
    often = revisits.groupBy(F.col("refers").alias("record_id")).agg(F.count(F.lit(1)).alias("often"))
    named = records.where("record_type = 'response'").select("record_id", F.col("page_id").alias("refers_to")).join(often, "record_id")
    named = settle(named.select(F.col("record_id").alias("refers"), "refers_to", "often"), "responses")
    none = F.lit(None).cast("long").alias("refers_to")
    return records.where("record_type = 'response'").select(*result, none).unionByName(join_hot(revisits, named, ["refers"]).select(*result, "refers_to"))
