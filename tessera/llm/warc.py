"""ARC archives to WARC: conversion, writing and reading.

An ARC record is one header line, whose fields the archive's version block declares, and as many bytes as that line says.
``convert`` parses it and synthesises the WARC record that says the same: identifier, timestamp, type and digest. Archives
are written by Spark's text writer, a gzip member a record, so they may lie in any store that Spark reaches; a new archive
begins at a bounded size. They are read by declared lengths, not by separators.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.skew import spread_join

#: Field names of the two versions' header lines (fixed values of the format).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = b"\r\n"
#: Smaller payloads are stored each time.
LEAST_REVISIT = 1000
#: Bytes from which an archive is full: it has at most one record more.
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _field(value: str | None) -> str:
    """White space and controls would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "-")


def arc_block(version: int, date: str, origin: str = "tessera") -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 {origin}\n{' '.join(FIELDS[version])}\n".encode()
    line = {1: f"filedesc://{origin}.arc 0.0.0.0 {date} text/plain {len(body)}", 2: f"filedesc://{origin}.arc 0.0.0.0 {date} text/plain 200 - - 0 {origin}.arc {len(body)}"}[version]
    return f"{line}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, date: str, content: bytes, ctype: str = "text/html", ip: str = "0.0.0.0", offset: int = 0) -> bytes:
    more = "" if version == 1 else f" 200 - - {offset} tessera.arc"
    return f"{_field(url)} {ip} {date} {ctype}{more} {len(content)}\n".encode() + content + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, content) of each record after the version block. The URL is what stands before the other fields, so a
    blank in it does no harm. Raises ValueError on a header that doesn't fit or on a truncated record."""
    at, fields = 0, None
    view = memoryview(data)
    while at < len(data):
        if data[at] == 10:  # the line ends between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if fields is None:
            parts = line.split(" ")
            if not line.startswith("filedesc://") or not parts[-1].isdigit():
                raise ValueError(f"no version block: {line[:80]!r}")
            body = bytes(view[end + 1 : end + 1 + int(parts[-1])])
            head, names = body.decode().split("\n")[:2]
            if int(head.split(" ")[0]) not in FIELDS:
                raise ValueError(f"unknown version: {head!r}")
            fields = names.split(" ")
            at = end + 1 + len(body)
            continue
        parts = line.rsplit(" ", len(fields) - 1)
        if end < 0 or len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"bad header: {line[:80]!r}")
        length = int(parts[-1])
        if end + 1 + length > len(data):
            raise ValueError(f"truncated: {line[:80]!r}")
        yield dict(zip(fields, parts, strict=True)), bytes(view[end + 1 : end + 1 + length])
        at = end + 1 + length


def _split_http(content: bytes) -> tuple[bytes, bytes] | None:
    if not content.startswith(b"HTTP/"):
        return None
    head, found, body = content.partition(b"\r\n\r\n")
    return (head + b"\r\n\r\n", body) if found else (content, b"")


def convert(header: dict[str, str], content: bytes, more: dict[str, str] | None = None, refers_to: tuple[str, str] | None = None) -> bytes:
    """One WARC record, without the two line ends that close it. Content with an HTTP head becomes a response, else a
    resource; with ``refers_to`` (record id, page) a revisit, which keeps the head and drops the payload. The id derives
    from date, payload and page (else URL), so that a conversion that runs twice gives the same archive."""
    date = header["Archive-date"].ljust(14, "0")
    http = _split_http(content)
    payload = http[1] if http else content
    digest = hashlib.sha1(payload).digest()
    kind = "revisit" if refers_to else "response" if http else "resource"
    block = http[0] if refers_to and http else b"" if refers_to else content
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(date, digest, (more or {}).get("Page-ID", header["URL"])),
        "WARC-Date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "WARC-Target-URI": header["URL"],
        "WARC-IP-Address": header["IP-address"],
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response" if http else header["Content-type"],
    }
    if refers_to:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to[0], "Refers-To-Page-ID": refers_to[1]}
    lines |= (more or {}) | {"Payload-Length": str(len(payload)), "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + CRLF + block


def record_id(date: str, digest: bytes, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {digest.hex()} {page}')}>"


def read_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive, given in pieces; holds one record at a time."""
    held = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(chunks, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    at = 0
    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                break
        if end < 0:
            if held.strip(CRLF):
                raise ValueError("truncated header")
            return
        first, *rest = bytes(held[:end]).strip(CRLF).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:80]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        length = int(headers["Content-Length"])
        if not fill(end + 4 + length):
            raise ValueError("truncated record")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]
        while fill(1) and held[:1] in (b"\r", b"\n"):
            del held[:2]
        at = 0


def unzipped(data: bytes, feed: int = 1 << 16, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces; a little is fed at a time, as members are small."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(view):
                raise ValueError("truncated gzip member")
            part = view[at : at + feed]
            at += len(part)
            out = z.decompress(part, step)
            while out:
                yield out
                out = z.decompress(z.unconsumed_tail, step) if not z.eof else b""
            at -= len(z.unused_data)


def first_copies(pages: DataFrame, page: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(__digest, __rows, __first): of payloads of ``least`` bytes or more that occur on several rows, their number and the
    largest page."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    digests = pages.select(F.sha1(body).alias("__digest"), F.octet_length(body).alias("__n"), F.col(page).alias("__page")).where(F.col("__n") >= least)
    return digests.groupBy("__digest").agg(F.count("*").alias("__rows"), F.max("__page").alias("__first")).where("__rows > 1 and __first is not null")


def records(pages: DataFrame, first: DataFrame, date: str = "20240101000000", page: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row for each page with ``record``, its WARC record. Each batch of pages becomes two ARC archives, of version 1
    (even pages) and 2 (odd ones), which are then parsed and converted. Null payloads are empty, null urls are ``-``. Page
    numbers travel as text, as whole numbers with nulls between them would become inexact in a batch. Rows that repeat a page
    are written each; other columns don't matter."""
    body = F.coalesce(F.col(payload), F.lit(""))
    # only large payloads can meet a copy; others get a key of their own, so that empty ones don't gather
    digest = F.when(F.octet_length(body) >= LEAST_REVISIT, F.sha1(F.encode(body, "UTF-8"))).otherwise(F.coalesce(F.col(page).cast("string"), F.lit("")))
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), body.alias("html"), digest.alias("__digest"))
    copies = first.agg(F.sum("__rows")).first()[0] or 0
    rows = spread_join(rows, first, ["__digest"], "__rows", copies, ["page"], "left").select(F.col("page").cast("string").alias("page"), "url", "html", F.when(F.col("__first") > F.col("page"), F.col("__first")).cast("string").alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            archives = {v: [arc_block(v, date)] for v in FIELDS}
            told: dict[int, list] = {v: [] for v in FIELDS}
            for p, u, html, f in zip(batch["page"].tolist(), batch["url"].tolist(), batch["html"].tolist(), batch["first"].tolist(), strict=True):
                data = html.encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                v = 2 if p and int(p) % 2 else 1
                archives[v].append(arc_record(v, u, date, head + data, offset=len(archives[v])))
                told[v].append((p, f))
            out = []
            for v, parts in archives.items():
                for (header, content), (p, f) in zip(read_arc(b"".join(parts)), told[v], strict=True):
                    to = None
                    if f:
                        body = hashlib.sha1((_split_http(content) or (b"", content))[1]).digest()
                        to = (record_id(date, body, f), f)
                    out.append(convert(header, content, {"Page-ID": p} if p else {}, to))
            yield pd.DataFrame({"record": out})

    return rows.mapInPandas(run, "record binary")


def member(record: bytes) -> bytes:
    """A record as a gzip member. A member ends in its length, whose highest byte isn't 0 from 16 MiB on; an empty member
    then follows, so that what comes out always ends in a 0 byte."""
    made = gzip.compress(record + CRLF + CRLF, 6, mtime=0)
    return made if made[-1] == 0 else made + gzip.compress(b"", mtime=0)


def write(records: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> None:
    """Archives of ``most`` bytes and a record at most, one a file. The text writer puts out the bytes of a string as they
    are, and a separator after each: the 0 byte that every member ends in."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for record in batch["record"]:
                held.append(member(record))
                size += len(held[-1])
                if size >= most:
                    yield pd.DataFrame({"archive": [b"".join(held)[:-1]]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [b"".join(held)[:-1]]})

    archives = records.mapInPandas(packed, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile=1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder: headers, the payload's full length and digest, and the block. Of
    a record that holds its payload both are found anew, and must be what its headers say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                held = 0
                for h, block in read_warc(unzipped(content)):
                    digest, length = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(h["Payload-Length"])
                    body = (_split_http(block) or (b"", block))[1]
                    if h["WARC-Type"] != "revisit" and (hashlib.sha1(body).hexdigest() != digest or len(body) != length):
                        raise ValueError(f"digest or length of {h['WARC-Record-ID']} does not fit its payload")
                    rows.append((h.get("Page-ID"), h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Date"], h.get("WARC-Target-URI"), length, digest, h.get("Refers-To-Page-ID"), block))
                    held += len(block)
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = ["page", "record_id", "record_type", "date", "uri", "payload_bytes", "payload_digest", "refers", "block"]
    schema = "page string, record_id string, record_type string, date string, uri string, payload_bytes long, payload_digest string, refers string, block binary"
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(run, schema)
