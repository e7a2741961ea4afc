"""WARC: converts legacy ARC archives, and reads WARC archives.

An ARC archive is a run of records, each a header line, so many bytes as the
line declares, and a line feed. The first record of a file, ``filedesc:``, names
the version and the fields of the header lines that follow: version 1 has URL,
IP address, date, content type and length; version 2 also has result code,
checksum, location, offset and file name. The converter reads the lines by the
file's own version and synthesises WARC 1.1 records: an identifier from the
record's place in its archive and its content, a timestamp from the 14-digit
date, a type, and SHA-1 digests of block and payload. A version block gives a
``warcinfo``, an HTTP response a ``response`` or ``revisit``, anything else, like a
``dns:`` look-up, a ``resource`` whose payload is its block. Of responses with equal
payloads that with the largest id is the response, the others revisit it.

Records are bytes throughout, in any encoding. Archives are written by Spark's text
sink, which puts out the bytes that it is given and whose line separator is the
formats' record separator, and read by its binary source, so that any file system
that Spark knows will do. A file is one gzip member and holds a bounded number of
records.

Defined cases: a null payload is empty, a null URL is ``urn:none``; spaces and
controls in a URL are percent-encoded in the archives; a record without an id
has a null one, revisits the response of its payload like any other, and is a
response itself only if no record of that payload has an id; an id header that
isn't a number is no id; rows that repeat an id and payload are one response
and its revisits of the same id; an HTTP header may end in bare line feeds, and
its own ``Content-Length`` is never relied on for records of this converter; a declared length that runs past the file, or a
malformed line, raises ``ValueError``; an empty file has no records; an empty
table gives empty archives; other columns of the table are never looked at. The
``payload`` read back is text, with U+FFFD for bytes that aren't UTF-8; ``content``
has the bytes themselves.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import shared_path, written

# The field lists of ARC header lines by version, and of WARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space of URLs
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _escaped(url: Column) -> Column:
    """A URL without spaces and control characters."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.when(url != "", url), F.lit("urn:none")), " ", "%20"), r"[\x00-\x20\x7F]", "%09")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filedesc(version: int, date: str) -> str:
    """The version block that begins an ARC file: a record like any other."""
    body = f"{version} 0 Loomwell\n{ARC_FIELDS[version]}\n"
    line = f"filedesc://pages.arc 0.0.0.0 {date} text/plain" + (" 200 - - 0 pages.arc" if version == 2 else "")
    return f"{line} {len(body)}\n{body}"


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", per_file: int = 2000) -> None:
    """pages (page_id, url, html) as ARC files under ``path``: HTTP responses that carry the id in a header."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(_escaped(F.col("url")).alias("url"), F.concat(head, body).alias("content"))
    fields = [F.col("url"), F.lit("0.0.0.0"), F.lit(date), F.lit("text/html")]
    fields += [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc")] if version == 2 else []
    record = F.concat(F.concat_ws(" ", *fields, F.octet_length("content").cast("string")), F.lit("\n"), F.col("content"))
    rows = rows.select(record.cast("binary").alias("record"))
    block = _filedesc(version, date).encode()

    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each file begins with its version block: one before every ``per_file`` - 1 records."""
        room = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                if not room:
                    yield pd.DataFrame({"record": [block]})
                    room = per_file - 1
                part = batch[at : at + room]
                yield part
                at, room = at + len(part), room - len(part)

    _write(rows.mapInPandas(with_header, "record binary"), path, "\n", per_file)


def _write(records: DataFrame, path: str, separator: str, per_file: int) -> None:
    """Column ``record`` (bytes) as files of so many records; a cast to string doesn't touch the bytes."""
    records.select(F.col("record").cast("string")).write.option("lineSep", separator).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")


def _opened(content: bytes) -> io.BufferedReader:
    """A file's plain bytes, unzipped as they are read: a task holds the file as it is stored, and one record."""
    raw = io.BytesIO(bytes(content))
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if raw.getvalue()[:2] == b"\x1f\x8b" else raw, 1 << 16)


def parse_arc(file: bytes | io.BufferedReader, infos: bool = False) -> Iterator[dict]:
    """The records of one ARC file, by its own version's header lines and the lengths they declare.

    infos: version blocks too.
    """
    file = _opened(file) if isinstance(file, bytes) else file
    at, names = 0, None
    while line := file.readline():
        if not line.endswith(b"\n"):
            raise ValueError("an ARC header line has no end")
        values = line[:-1].decode("utf-8", "replace").split(" ")
        if not values[-1].isdecimal():
            raise ValueError("an ARC header line has no length")
        length = int(values[-1])
        body = file.read(length)
        if len(body) != length:
            raise ValueError("an ARC record is cut off")
        if values[0].startswith("filedesc:"):
            lines = body.decode("utf-8", "replace").split("\n")
            names = lines[1].split(" ")
            if ARC_FIELDS.get(int(lines[0].split(" ")[0])) != lines[1]:
                raise ValueError(f"unknown ARC version block {lines[0]!r}")
        elif names is None:
            raise ValueError("an ARC file begins without its version block")
        elif len(values) != len(names):
            raise ValueError(f"an ARC header line has {len(values)} fields, not {len(names)}")
        if infos or not values[0].startswith("filedesc:"):
            yield dict(zip(ARC_FIELDS[1].split(" ")[:4], values, strict=False)) | {"offset": at, "block": body}
        at += len(line) + length
        if file.peek(1)[:1] == b"\n":
            at += len(file.read(1))


_HEADER_END = re.compile(rb"\r?\n\r?\n")


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, the header with its blank line, and the payload of an HTTP response."""
    found = _HEADER_END.search(block)
    head, payload = (block[: found.end()], block[found.end() :]) if found else (block, b"")
    lines = head.decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head, payload


def _number(x: str | None) -> int | None:
    return int(x) if x and len(x) < 19 and re.fullmatch("-?[0-9]+", x) else None


@dataclass(frozen=True)
class Record:
    """An ARC record with what the converter synthesises for it."""

    kind: str
    offset: int
    url: str
    date: str
    mime: str
    page_id: int | None
    record_id: str
    head: bytes
    payload: bytes
    digest: str


def records(name: str, file: bytes | io.BufferedReader) -> Iterator[Record]:
    """The records of one ARC file: the same archive and record give the same identifier again."""
    for r in parse_arc(file, infos=True):
        kind, fields, head, payload = "resource", {}, b"", r["block"]
        if r["URL"].startswith("filedesc:"):
            kind = "warcinfo"
        elif payload.startswith(b"HTTP/"):
            kind, (fields, head, payload) = "response", _http(payload)
        d = r["Archive-date"].ljust(14, "0")
        stamp = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        digest, own = base32_sha1(payload), fields.get("x-page-id")
        rid = uuid.uuid5(NAMESPACE, f"{name.rsplit('/', 1)[-1]}#{r['offset']} {r['URL']} {own} {digest}")
        yield Record(kind, r["offset"], r["URL"], stamp, r["Content-type"], _number(own), f"<urn:uuid:{rid}>", head, payload, digest)


FACT = "path string, offset long, kind string, page_id long, record_id string, payload_length long, digest string"


def _facts(files: DataFrame) -> DataFrame:
    """One narrow row for each record: its place, id, and payload's length and digest."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in FACT.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, r.offset, r.kind, r.page_id, r.record_id, len(r.payload), r.digest) for r in records(name, _opened(content))]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})

    return files.mapInPandas(work, FACT)


def _warc(r: Record, to: tuple[str, int] | None) -> bytes:
    """The WARC record; ``to`` is the record and page that it revisits."""
    block = r.head if to else r.head + r.payload
    kind, mime = r.kind, {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}.get(r.kind, r.mime)
    fields = [("WARC-Type", "revisit" if to else kind), ("WARC-Record-ID", r.record_id), ("WARC-Date", r.date)]
    if kind == "warcinfo":
        block = b"software: Loomwell\r\nformat: WARC File Format 1.1\r\ndescription: converted from an ARC file of version " + r.payload[:1] + b"\r\n"
        fields.append(("WARC-Filename", r.url.removeprefix("filedesc://")))
    else:
        fields.append(("WARC-Target-URI", r.url))
    if to:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", to[0]), ("X-Refers-To-Page", str(to[1])), ("X-Payload-Length", str(len(r.payload)))]
    if kind != "warcinfo":
        fields.append(("WARC-Payload-Digest", f"sha1:{r.digest}"))
    fields += [("WARC-Block-Digest", "sha1hex:" + hashlib.sha1(block).hexdigest()), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, per_file: int = 2000) -> None:
    """ARC files to WARC files. Payloads of ``least_bytes`` or more that are equal are stored once.

    Which records revisit which is found from a narrow table of digests, where a
    payload that a large share of the records has is counted before the shuffle.
    Each file's revisits then go to it as a list, no longer than its records;
    payloads are never shuffled, only files as they are stored.
    """
    files = _files(spark, arc_path)
    facts = written(_facts(files), "records")
    keyed = facts.filter((F.col("payload_length") >= least_bytes) & (F.col("kind") == "response"))
    # the largest id, nulls last; of rows that repeat it the largest record identifier
    groups = keyed.groupBy("digest", "payload_length").agg(F.max(F.struct("page_id", "record_id")).alias("to"), F.count(F.lit(1)).alias("n"))
    winners = groups.filter("n > 1 and to.page_id is not null").select("digest", "payload_length", "to")
    revisits = keyed.join(winners, ["digest", "payload_length"]).filter(F.col("record_id") != F.col("to.record_id"))
    listed = revisits.groupBy("path").agg(F.collect_list(F.struct("offset", "to.record_id", "to.page_id")).alias("revisits"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, list_ in zip(batch["path"], batch["content"], batch["revisits"], strict=True):
                to = {x["offset"]: (x["record_id"], x["page_id"]) for x in (list_ if list_ is not None else [])}
                rows, size = [], 0
                for r in records(name, _opened(content)):
                    rows.append(_warc(r, to.get(r.offset)))
                    size += len(rows[-1])
                    if size > 8 << 20:
                        yield pd.DataFrame({"record": pd.Series(rows, dtype=object)})
                        rows, size = [], 0
                yield pd.DataFrame({"record": pd.Series(rows, dtype=object)})

    # a task for each file, however many there are
    tasks = max(1, facts.agg(F.count_distinct("path")).first()[0])
    whole = files.repartition(tasks, "path").join(listed, "path", "left").select("path", "content", "revisits")
    _write(whole.mapInPandas(work, "record binary"), warc_path, "\r\n\r\n", per_file)


def parse_warc(file: bytes | io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one WARC file."""
    file = _opened(file) if isinstance(file, bytes) else file
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC header is malformed")
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b"\n"):
            k, colon, v = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise ValueError("a WARC header is malformed")
            fields[k.strip().lower()] = v.strip()
        length = _number(fields.get("content-length"))
        block = file.read(length) if length is not None else b""
        if length is None or len(block) < length:
            raise ValueError("a WARC record is cut off")
        yield fields, block
        while file.peek(1)[:1] in (b"\r", b"\n"):
            file.read(1)


WARC = "page_id long, record_type string, record_id string, target_uri string, date string, content binary, payload_bytes long, payload_digest string, refers_to_record string, refers_to long, block_ok boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files under ``path``. A revisit has no payload of its own (null);
    its length and digest are those of the full payload. Of other writers' revisits the
    length is the HTTP header's, null where that has none or the payload was coded. A
    ``warcinfo`` has the description of its archive, without target and digest."""

    def one(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields["warc-type"]
        http, _, payload = _http(block) if kind in ("response", "revisit") else ({}, b"", block)
        told = fields.get("warc-block-digest", "")
        ok = told == ("sha1hex:" + hashlib.sha1(block).hexdigest() if told.startswith("sha1hex:") else "sha1:" + base32_sha1(block))
        length, digest = len(payload), base32_sha1(payload) if kind != "warcinfo" else None
        if kind == "revisit":
            coded = http.get("transfer-encoding", "identity") != "identity"
            length = _number(fields.get("x-payload-length") or (None if coded else http.get("content-length")))
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return (
            _number(http.get("x-page-id")), kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-date"],
            None if kind == "revisit" else payload, length, digest, fields.get("warc-refers-to"), _number(fields.get("x-refers-to-page")), ok,
        )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in WARC.split(", ")]
        framed = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for fields, block in parse_warc(_opened(content)):
                    rows.append(one(fields, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield framed(rows)
                        rows, size = [], 0
                yield framed(rows)

    return _files(spark, path).mapInPandas(work, WARC).withColumn("payload", F.make_valid_utf8(F.col("content").cast("string")))


def pages_through_archives(pages: DataFrame, version: int = 1) -> DataFrame:
    """Writes ``pages`` as ARC, converts that to WARC, and reads the WARC files back."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc)
    return read_warc(spark, warc).filter(F.col("record_type").isin("response", "revisit"))
