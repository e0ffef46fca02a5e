"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing: a payload's SHA-1 decides which record holds it: the smallest id among equal
payloads is the ``response``, the others are ``revisit`` records that refer to it (payloads
shorter than ``revisit_from`` bytes are always responses).  The smallest id is a grouped
minimum combined before the shuffle; it is joined back on the digest, where adaptive
execution splits a payload that a third of all rows share.  Each task writes its rows as one
gzip member a record to archives of bounded size, under a name of its own attempt, and then
moves them to the final name: a repeated task replaces its files.  Archives lie under the
shared folder; any store that Arrow can write works.

Reading: Spark reads whole archives (bounded by the writer; at most 2 GB each).  Each member
must inflate, start with a version line, have headers, a block of the stated length and the
stated digest.  After a failed check the reader searches for the next offset at which a
valid member (or, in plain archives, a record after a version line) begins, goes on there,
and logs the bytes between as a gap with the reason.  Inside a member the same search goes
over the inflated bytes, also those that came out before inflating failed: good records are
kept, and a gap there has the member's place in the archive and its inflated bytes in the
reason.  If inflating fails, only records with a digest of their own are trusted, and a
member of a single record is a gap as a whole.

Defined cases: a null payload is empty; rows that repeat the smallest id and the payload are
all responses; a null id is written as ``null`` and refers to the smallest id with the same
payload (a response if there is none); an empty table gives no record; other columns are
ignored.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from heatwise.llm.scratch import Scratch

ARCHIVE_BYTES = 32 << 20
_STEP = 1 << 14
_FIRST_STEP = 1 << 12
DATE = "2000-01-01T00:00:00Z"
URN = "urn:page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One plain WARC record."""
    name = "null" if page_id is None else page_id
    block = _HTTP if revisit else _HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{name}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
             f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int, strict: bool = False) -> tuple[dict, int]:
    """(record, end offset) of the record that begins at ``at``; Damaged if a check fails or,
    if ``strict``, none of its digests covers its block or payload."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    start, end = head + 4, head + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where stated")
    block = data[start:end]
    stated = headers.get("warc-block-digest")
    if stated and stated != "sha1:" + base32_sha1(block):
        raise Damaged("block digest differs")
    kind = headers.get("warc-type")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if strict and not stated and (kind == "revisit" or not digest):
        raise Damaged("no digest in a damaged member")
    if kind == "revisit":
        payload, size = None, headers.get("x-payload-length", "")
        size = int(size) if size.isdigit() else None
    else:
        size = len(payload)
        if digest and digest != base32_sha1(payload):
            raise Damaged("payload digest differs")
    return {"record_type": kind, "record_id": headers.get("warc-record-id", "").strip("<>"),
            "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
            "target_uri": headers.get("warc-target-uri"), "payload_digest": digest or None,
            "payload_bytes": size, "payload": payload}, end + 4


def _inflate(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int, str | None]:
    """(inflated bytes, end, failure) of the member at ``at``, up to the failure; with ``most``,
    end is the first offset at which so many bytes had come out."""
    inflate, out, size = zlib.decompressobj(31), [], 0
    while at < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            part = inflate.decompress(data[at:at + _STEP])
            if most is not None and size + len(part) >= most:
                raise zlib.error
            at += min(_STEP, len(data) - at) - len(inflate.unused_data)
            out.append(part)
            size += len(part)
        except zlib.error:
            try:
                while at < len(data) and not before.eof and (most is None or size < most):
                    part = before.decompress(data[at:at + 1])
                    at += 1
                    out.append(part)
                    size += len(part)
            except zlib.error:
                pass
            return b"".join(out), at, "member does not inflate"
    return b"".join(out), at, None if inflate.eof else "member is cut off"


def _member(data: bytes, at: int) -> tuple[list[dict | str], int, str | None]:
    """(records and reasons of gaps, end, failure) of the gzip member at ``at``; after a
    failure, end is where the last good record had come out."""
    inflate, parts, last, step = zlib.decompressobj(31), [], at, _FIRST_STEP
    view = memoryview(data)
    try:
        # steps grow with the member, so what is read past its end stays in proportion to it
        while last < len(data) and not inflate.eof:
            part = view[last:last + step]
            parts.append(inflate.decompress(part))
            last += len(part) - len(inflate.unused_data)
            step = min(2 * step, _STEP)
        plain, failure = b"".join(parts), None if inflate.eof else "member is cut off"
    except zlib.error:
        plain, _, failure = _inflate(data, at)
    out, place, why, good = [], 0, None, 0
    strict = failure == "member does not inflate"
    while place < len(plain):
        for start in _chain(place, _starts(plain, place + 1, False)):
            try:
                found, end = parse_record(plain, start, strict)
                break
            except Damaged as wrong:
                why = why or str(wrong)
        else:
            break
        if start > place:
            out.append(f"{why} (inflated bytes {place} to {start})")
        out.append(found)
        place, why, good = end, None, end
    if failure or plain and not good:
        rest = plain[good:good + 5]
        if not good or len(out) == 1 and not (rest and b"WARC/".startswith(rest)):
            raise Damaged(failure or why)
        return out, _inflate(data, at, good)[1], failure
    if place < len(plain):
        out.append(f"{why} (inflated bytes {place} to {len(plain)})")
    return out, last, None


def _starts(data: bytes, at: int, packed: bool) -> Iterator[int]:
    if packed:
        while (at := data.find(_MAGIC, at)) >= 0:
            yield at
            at += 1
    else:
        for hit in _VERSION.finditer(data, at):
            yield hit.start()


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict | None]]:
    """("record" or "gap", start, end, reason of a gap, record) over a whole archive."""
    packed = data.startswith(_MAGIC[:2]) or (_MAGIC in data and not _VERSION.search(data))
    at, failure = 0, None
    while at < len(data):
        why, good = failure, None
        for start in _chain(at, _starts(data, at + 1, packed)):
            try:
                good = _member(data, start) if packed else _plain(data, start)
                break
            except Damaged as wrong:
                why = why or str(wrong)
        start = start if good else len(data)
        if start > at or failure:
            yield "gap", at, start, why, None
        if not good:
            return
        for found in good[0]:
            if isinstance(found, str):
                yield "gap", start, good[1], found, None
            else:
                yield "record", start, good[1], None, found
        at, failure = good[1], good[2]
    if failure:
        yield "gap", at, at, failure, None


def _plain(data: bytes, at: int) -> tuple[list[dict | str], int, str | None]:
    found, end = parse_record(data, at)
    return [found], end, None


def _chain(first: int, rest: Iterator[int]) -> Iterator[int]:
    yield first
    yield from rest


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Lazily write the archives; one row (path, records, bytes) for each.  Evaluate once."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        body.cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.groupBy("sha").agg(F.min("id").alias("first"))
    marked = rows.join(first, "sha").select(
        "id", "url", "payload", "first",
        (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
         & (F.length("payload") >= revisit_from)).alias("revisit"))
    root = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        done, out, size, count = [], None, 0, 0

        def close():
            nonlocal out, size, count
            if out is not None:
                out.close()
                store.move(f"{base}/.{name()}-{task.taskAttemptId()}", f"{base}/{name()}")
                done.append((f"{root}/{name()}", count, size))
            out, size, count = None, 0, 0

        def name():
            return f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz"

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/.{name()}-{task.taskAttemptId()}")
                member = gzip.compress(record(row["id"], row["url"], row["payload"], row["first"], row["revisit"]),
                                       compresslevel=1, mtime=0)
                out.write(member)
                size += len(member)
                count += 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])
    return marked.mapInArrow(run, "path string, records long, bytes long")


_READ = ("kind string, path string, start long, end long, reason string, record_type string, record_id string, "
         "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary")


def _rows(path: str, data: bytes, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """The records and gaps of one archive."""
    names = [part.split()[0] for part in _READ.split(", ")]
    kinds = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

    rows, size = [], 0
    for kind, start, end, reason, found in salvage(data):
        row = {"kind": kind, "path": path, "start": start, "end": end, "reason": reason, **(found or {})}
        if not with_payload:
            row["payload"] = None
        rows.append(row)
        size += len(row.get("payload") or b"")
        if size > ARCHIVE_BYTES or len(rows) >= 10_000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def read_archives(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """Records (kind ``record``) and quarantined byte ranges (kind ``gap``) of a folder's archives."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
             .select("path", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), with_payload)
    return files.mapInArrow(run, _READ)


def read_listed(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """As :func:`read_archives`, of the archives that a manifest of ``write_archives`` names and no
    others: files that a lost attempt left in the folder are not read."""
    count = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = fs.FileSystem.from_uri(path)
                with store.open_input_stream(base) as source:
                    data = source.read()
                yield from _rows(path, data, with_payload)
    return manifest.select("path").repartition(max(count, 1), "path").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, scratch: Scratch, revisit_from: int = 0) -> DataFrame:
    """Write the archives, then read them back without payloads: records and gaps."""
    written = scratch.keep(write_archives(pages, f"{scratch.root}/warc", revisit_from=revisit_from), "manifest")
    return read_listed(written, with_payload=False)
