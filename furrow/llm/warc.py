"""Web archives: writing ARC, converting ARC to WARC, reading both.

Archives are gzip files of one member per record in the folder that the cluster shares; each is
written under a name of its own by one task attempt and counts only if its row reached the manifest,
so that a lost executor leaves at most a file that nobody reads. The converter parses ARC version 1
and 2 header lines and their declared lengths and synthesises the WARC fields that ARC lacks:
record identifiers from what identifies the capture, ISO timestamps, record types, and SHA-1
digests. Captures whose payload equals another's are written as revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.graph import hot_from
from furrow.session import cut, scratch

#: Bytes of records, before compression, after which a task begins another archive.
ROLL = 64 << 20
#: Payloads from this size on are deduplicated.
LEAST_SHARED = 1000
LEVEL = 1
#: Header fields that follow the URL, by ARC version, and the revisit profile.
ARC_FIELDS = {
    "1": ("ip", "date", "type", "length"),
    "2": ("ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SOURCE = "X-Source-Id"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def sha1_base32(data: bytes) -> str:
    """A digest as WARC headers hold it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _header_url(url: str | None) -> str:
    """A URL that fits a space-separated line: what is not printable ASCII is percent-encoded."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else "about:blank"


@dataclass
class Record:
    """One archived record; ``fields`` are its header's, ``body`` the declared bytes after it."""

    kind: str
    url: str
    date: str
    body: bytes
    fields: dict[str, str] = field(default_factory=dict)
    offset: int = 0

    def http(self) -> tuple[dict[str, str], bytes, bytes]:
        """The HTTP header's fields, its bytes, and the payload; a body without one is all payload."""
        if not self.body.startswith(b"HTTP/"):
            return {}, b"", self.body
        head, mark, payload = self.body.partition(b"\r\n\r\n")
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + mark, payload


def arc_version_block(name: str, version: str = "1", date: str = "20240101000000") -> bytes:
    """The record that opens an ARC archive and names its header fields."""
    names = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 Origin\n{names[version]}\n".encode()
    more = "" if version == "1" else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, body: bytes, version: str = "1", date: str = "20240101000000", ip: str = "0.0.0.0", kind: str = "text/html", name: str = "-") -> bytes:
    """One ARC record in the header form of a version."""
    more = "" if version == "1" else f" 200 - - 0 {name}"
    return f"{_header_url(url)} {ip} {date} {kind}{more} {len(body)}\n".encode() + body + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[Record]:
    """The records of an ARC stream, its version blocks left out but heeded for the header form."""
    version, offset = "1", 0
    while line := stream.readline():
        if not line.strip():
            offset += len(line)
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        size = int(parts[-1])
        body = stream.read(size)
        if len(body) < size:
            raise ValueError(f"an ARC record at {offset} declares {size} bytes and has {len(body)}")
        if parts[0].startswith("filedesc://"):
            version = body.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        else:
            names = ARC_FIELDS[version]
            # A URL may hold raw spaces; the other fields are counted from the line's end.
            got = dict(zip(names, parts[-len(names):], strict=True))
            yield Record("arc", " ".join(parts[: -len(names)]), got["date"], body, got, offset)
        offset += len(line) + size


def warc_record(kind: str, url: str, date: str, block: bytes, record_id: str, digest: str, more: dict[str, str] | None = None) -> bytes:
    """One WARC/1.0 record."""
    lines = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response" if block.startswith(b"HTTP/") else "text/html",
        "WARC-Payload-Digest": digest, "WARC-Block-Digest": sha1_base32(block), **(more or {}), "Content-Length": str(len(block)),
    }
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[Record]:
    """The records of a WARC stream; a block that differs from its digest is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        body = stream.read(size)
        if len(body) < size or fields.get("warc-block-digest", "") not in ("", sha1_base32(body)):
            raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
        yield Record(fields["warc-type"], fields.get("warc-target-uri", ""), fields.get("warc-date", ""), body, fields)


def iso_date(stamp: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC timestamp."""
    s = (stamp + "00000101000000"[len(stamp):]) if len(stamp) < 14 else stamp
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def record_id(url: str, date: str, digest: str, source: str | None) -> str:
    """The same identifier for the same capture, whoever converts it."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, digest, source or '')))}"


class _Folder:
    """The shared folder, opened anew wherever it is used."""

    def __init__(self, uri: str):
        self.uri = uri

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def archives(self, records: Iterator[bytes], suffix: str, opening) -> Iterator[tuple[str, int, int]]:
        """Write records into as many archives as they fill; yields (name, records, bytes on disk)."""
        where, path = self.open()
        out, name, count, size, packed = None, "", 0, 0, 0
        for record in records:
            if out is None:
                where.create_dir(path, recursive=True)
                name = f"{uuid.uuid4().hex}{suffix}"
                out, count, size = where.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                first = _member(opening(name))
                out.write(first)
                packed = len(first)
            data = _member(record)
            out.write(data)
            count, size, packed = count + 1, size + len(record), packed + len(data)
            if size >= ROLL:
                out.close()
                yield name, count, packed
                out = None
        if out is not None:
            out.close()
            yield name, count, packed

    def read(self, name: str) -> BinaryIO:
        where, path = self.open()
        raw = where.open_input_stream(f"{path}/{name}", compression=None)
        return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)


_MANIFEST = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _manifest(rows: Iterator[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _MANIFEST.types, strict=True)], schema=_MANIFEST)


def write_arc(df: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, version: str = "1", date: str = "20240101000000") -> DataFrame:
    """Archive pages as ARC captures of HTTP responses; returns the manifest (archive, n_records, n_bytes).

    Null pages have an empty payload, null URLs become about:blank, null ids leave out the id's header.
    """
    place = _Folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for source, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                    payload = html.as_py() or b""
                    mark = f"{_SOURCE}: {source}\r\n" if source.is_valid else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n"
                    yield arc_record(url.as_py(), head.encode() + payload, version, date)

        yield from _manifest(place.archives(records(), ".arc.gz", lambda name: arc_version_block(name, version, date)))

    narrow = df.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("binary"))
    return cut(narrow.mapInArrow(write, "archive string, n_records long, n_bytes long"))


_CAPTURE = "archive string, offset long, url string, date string, source string, n_bytes long, digest string"


def arc_captures(manifest: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, url, date, source, n_bytes, digest) of every capture; payloads stay in the archives."""
    place = _Folder(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with place.read(name) as stream:
                    for r in read_arc(stream):
                        head, _, payload = r.http()
                        rows.append((name, r.offset, r.url, r.date, head.get(_SOURCE.lower()), len(payload), sha1_base32(payload)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["archive", "offset", "url", "date", "source", "n_bytes", "digest"])

    return manifest.select("archive").mapInArrow(read, _CAPTURE)


def revisits(captures: DataFrame, least: int = LEAST_SHARED, rank: Column | None = None) -> DataFrame:
    """``captures`` with of_source, of_url, of_date: the capture that holds the same payload, else null.

    Of equal payloads of at least ``least`` bytes the capture with the largest ``rank`` (the source as
    a number, unless given; nulls are smallest, ties go to the later place) is the one that others
    revisit. The digests are reduced before the shuffle and joined back as one row for each; smaller
    payloads take no part in the join, and captures of a hot digest stay where they are: those digests,
    few by definition of the limit, go to every task.
    """
    limit = hot_from(captures.count())
    place = F.struct((F.col("source").try_cast("long") if rank is None else rank).alias("rank"), "archive", "offset", "source", "url", "date")
    shared = (
        captures.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max(place).alias("of"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("digest").alias("_digest"), "of", "n")
    )
    hot = F.broadcast(shared.where(F.col("n") > limit).drop("n"))
    cold = shared.where(F.col("n") <= limit).drop("n")
    large = captures.where(F.col("n_bytes") >= least)
    alone = captures.where(F.coalesce(F.col("n_bytes") < least, F.lit(True))).withColumns({c: F.lit(None).cast(shared.schema[c].dataType) for c in ("_digest", "of")})
    own = (F.col("archive") == F.col("of.archive")) & (F.col("offset") == F.col("of.offset"))
    same = F.col("digest") == F.col("_digest")
    rest = large.join(hot.select("_digest"), same, "left_anti").join(cold, same, "left")
    joined = large.join(hot, same).unionByName(rest).unionByName(alone)
    there = F.col("of").isNotNull() & ~own
    return joined.select(captures.columns + [F.when(there, F.col(f"of.{c}")).alias(f"of_{c}") for c in ("source", "url", "date")] + [there.alias("again")])


def convert(decided: DataFrame, arc_folder: str, warc_folder: str, tasks: int) -> DataFrame:
    """Write the WARC archives of decided captures, one for each ARC archive; returns the manifest.

    Payloads go straight from archive to archive: only the decisions are shuffled, by archive.
    """
    source, target = _Folder(arc_folder), _Folder(warc_folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def per_archive() -> Iterator[tuple[str, dict]]:
            name, rows = None, {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["archive"] != name:
                        if rows:
                            yield name, rows
                        name, rows = row["archive"], {}
                    rows[row["offset"]] = row
            if rows:
                yield name, rows

        def converted(name: str, rows: dict) -> Iterator[bytes]:
            with source.read(name) as stream:
                for r in read_arc(stream):
                    row = rows[r.offset]
                    _, head, _ = r.http()
                    date, digest = iso_date(r.date), row["digest"]
                    own = record_id(r.url, date, digest, row["source"])
                    if row["again"]:
                        at = iso_date(row["of_date"])
                        more = {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{record_id(row['of_url'], at, digest, row['of_source'])}>", "WARC-Refers-To-Target-URI": row["of_url"], "WARC-Refers-To-Date": at}
                        if row["of_source"] is not None:
                            more["WARC-Refers-To-Source-ID"] = row["of_source"]
                        yield warc_record("revisit", r.url, date, head, own, digest, more)
                    else:
                        yield warc_record("response", r.url, date, r.body, own, digest)

        def info(name: str) -> bytes:
            body = b"software: furrow\r\nformat: WARC File Format 1.0\r\n"
            head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
            return head.encode() + body + b"\r\n\r\n"

        for name, rows in per_archive():
            yield from _manifest(target.archives(converted(name, rows), ".warc.gz", info))

    ordered = decided.drop("url", "date").repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return cut(ordered.mapInArrow(write, "archive string, n_records long, n_bytes long"))


def warc_records(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every response and revisit record: record_id, record_type, url, date, source, payload_bytes,
    payload_digest (bare lower-case hex), refers_to_source and, if asked for, the payload.

    A response's digest is computed from its payload again and must be the header's.
    """
    place = _Folder(folder)
    names = ["record_id", "record_type", "url", "date", "source", "payload_bytes", "payload_digest", "refers_to_source", "payload"]
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(name: str) -> Iterator[tuple]:
        with place.read(name) as stream:
            for r in read_warc(stream):
                if r.kind not in ("response", "revisit"):
                    continue
                head, _, payload = r.http()
                digest = r.fields["warc-payload-digest"]
                if r.kind == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"the payload of {r.fields['warc-record-id']} is damaged")
                size = len(payload) if r.kind == "response" else int(head["content-length"])
                yield (r.fields["warc-record-id"].strip("<>"), r.kind, r.url, r.date, head.get(_SOURCE.lower()), size, _hex(digest), r.fields.get("warc-refers-to-source-id"), payload if with_payload else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(name):
                    held.append(row)
                    size += 300 + len(row[-1] or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    schema = "record_id string, record_type string, url string, date string, source string, payload_bytes long, payload_digest string, refers_to_source string, payload binary"
    found = manifest.select("archive").mapInArrow(read, schema)
    return found if with_payload else found.drop("payload")


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> tuple[DataFrame, str]:
    """Archive pages by way of ARC: the WARC manifest and the folder that holds its archives.

    A record per row: null pages have an empty payload, null URLs become about:blank, null ids leave
    the id's header out, repeated rows give a record each, an empty table no archive; other columns
    are left out. Of equal payloads of at least ``least`` bytes the one with the largest id is the
    response; of rows that repeat that id too, one of them.
    """
    spark = df.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    written = write_arc(df, arc, id_col, url_col, html_col)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = written.repartition(tasks)
    captures = cut(arc_captures(spread, arc))
    done = convert(revisits(captures, least), arc, warc, tasks)
    return done, warc
