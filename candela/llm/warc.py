"""WARC archives: a writer with revisit records, and a salvage reader.

The writer makes one record per row, each a gzip member, in archives of about `archive_bytes`. Of
rows with equal payloads of at least `revisit_bytes`, the one of the largest id is a response and
the others are revisits of it, which keep the HTTP header but not the payload.

The reader walks an archive member by member, or record by record where it is not compressed. A
record is taken if its member's check sum, version line, header, length and digest hold. After a
failed check it searches for the next gzip member that inflates to a version line, or the next
version line, whose record holds; what lies between is reported as a gap with its byte range and
reason, and all later records are recovered. The search goes on inside a member of several records
too; of a member that is cut short or whose check sum fails, as far as it inflates, a record is taken
if its digest holds and another record follows it.

Rows: a null payload is empty; null ids and urls are left out of the header and read back as null;
line breaks in a url are percent-encoded. Rows that repeat the largest id of their payload are all
responses. Empty tables give no archive. Other columns are not read. Archives are rows (path,
content), as Spark's binaryFile source gives them, so the reader works on files from elsewhere too;
one archive must fit in a task's memory.

Scale: payloads are shuffled once, by digest, to learn the largest id (a small aggregate; groups of
copies are split by the skew join); archives are a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t

REVISIT_BYTES, ARCHIVE_BYTES = 1000, 4 << 20
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes that are inflated at once.
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One record, not compressed; a revisit where refers_to is given."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{id}>"] * (id is not None)
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes for the same data."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) of all rows, as a table in the shared folder."""
    rows = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(payload), F.lit("")).alias("_body"))
    rows = rows.withColumn("_digest", F.when(F.octet_length("_body") >= revisit_bytes, F.sha1(F.col("_body").cast("binary"))))
    first = rows.where("_digest is not null").groupBy("_digest").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # short pages have a key of their own, so that they are not all dealt to one task
    rows = rows.withColumn("_digest", F.coalesce("_digest", F.concat(F.lit("-"), F.xxhash64("_id", "_url", "_body").cast("string"))))
    dealt = rows.join(first, "_digest", "left").select("_id", "_url", "_body", F.when(F.col("_first").eqNullSafe(F.col("_id")), None).otherwise(F.col("_first")).alias("_to"))

    def run(batches):
        task, parts, size, number = TaskContext.get().partitionId(), [], 0, 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

        for batch in t.sliced(batches, "_body"):
            for key, link, body, to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                one = member(record(key, link, body.encode(), to))
                parts.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield full()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield full()

    return t.stored(t.map_arrow(dealt, run, "path string, content binary"), "warc")


class Bad(Exception):
    """A check that failed."""


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a version line, checked, and the offset after it."""
    start = VERSION.match(data, at)
    if not start:
        raise Bad("no version line")
    blank = re.compile(rb"\r?\n\r?\n").search(data, start.end() - 2)
    if not blank:
        raise Bad("header without an end")
    fields = {}
    for line in data[start.end() : blank.start()].splitlines():
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Bad("no length")
    end = blank.end() + int(fields["content-length"])
    if end > len(data):
        raise Bad("block cut short")
    after = re.compile(rb"(\r?\n){2}").match(data, end)
    if not after:
        raise Bad("no end of record")
    block = data[blank.end() : end]
    http, split, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    sizes = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"type": kind, "url": fields.get("warc-target-uri"), "id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to")}
    if kind == "revisit":
        return out | {"payload": None, "bytes": int(sizes[1]) if sizes else None, "digest": digest}, after.end()
    found = hashlib.sha1(body).hexdigest()
    if re.fullmatch("[0-9a-f]{40}", digest) and digest != found:
        raise Bad("digest differs")
    return out | {"payload": body, "bytes": len(body), "digest": found, "verified": digest == found}, after.end()


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at this offset inflates to, the offset after it, and what is wrong with it."""
    press, out = zlib.decompressobj(31), []
    view = memoryview(data)
    spot = at
    while spot < len(data) and not press.eof:
        try:
            out.append(press.decompress(view[spot : spot + STEP]))
        except zlib.error as e:
            return b"".join(out), spot, f"member: {e}"
        spot += STEP
    if not press.eof:
        return b"".join(out), len(data), "member cut short"
    return b"".join(out), min(spot, len(data)) - len(press.unused_data), None


def _inside(body: bytes, damaged: bool) -> Iterator[dict | str]:
    """Records of an inflated member and reasons for what lies between. Of a damaged one a record is taken
    if its digest holds and another one follows."""
    at = 0
    while at < len(body):
        start, reason = at, None
        try:
            one, end = parse(body, at)
        except Bad as e:
            reason, one, end = str(e), None, len(body)
            for m in VERSION.finditer(body, at + 1):
                try:
                    one, end = parse(body, m.start())
                except Bad:
                    continue
                at = m.start()
                break
            yield f"{reason} (bytes {start} to {at if one else end} of the member)"
            if one is None:
                return
        if damaged and not (one.get("verified") and VERSION.match(body, end)):
            yield f"in a damaged member (bytes {at} to {end} of it)"
        else:
            yield one
        at = end


def _unit(data: bytes, at: int) -> tuple[list[dict | str], int, str | None]:
    """All records of the member, or the one plain record, at this offset, the offset after it, and what is
    wrong with the member."""
    if data[at : at + 3] != MAGIC:
        one, end = parse(data, at)
        return [one], end, None
    body, end, reason = _inflate(data, at)
    found = list(_inside(body, reason is not None))
    if not any(isinstance(x, dict) for x in found):
        raise Bad(reason or (found[0] if found else "empty member"))
    return found, end, reason


def _starts(data: bytes, at: int) -> Iterator[int]:
    """Offsets from `at` on where a member or a plain record may begin."""
    marks = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
    for m in marks.finditer(data, at):
        if data[m.start()] != 0x1F:
            yield m.start()
            continue
        press = zlib.decompressobj(31)
        try:
            if VERSION.match(press.decompress(memoryview(data)[m.start() : m.start() + 4096], 64)):
                yield m.start()
        except zlib.error:
            pass


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) for each record that holds, and (start, end, reason) for each gap, in order. In
    a member of several records the range is the member's."""
    at, ready = 0, None
    while at < len(data):
        try:
            found, end, reason = ready or _unit(data, at)
        except Bad as e:
            found, end, reason = [], at, str(e)
        ready = None
        after = end
        if reason:  # the end is not known: the next member or version line that holds
            after = len(data)
            for spot in _starts(data, at + 1):
                try:
                    ready = _unit(data, spot)
                except Bad:
                    continue
                after = spot
                break
        for one in found:
            yield at, after, one
        if reason:
            yield at, after, reason
        at = after


def read(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives (path, content): kind is record or gap; of a gap only path, start,
    end and reason are given."""

    def run(batches):
        names = ["path", "kind", "start", "end", "reason", "type", "id", "url", "refers_to", "payload", "bytes", "digest"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for a, b, one in salvage(content.as_py() or b""):
                    if isinstance(one, str):
                        rows.append((path, "gap", a, b, one, *[None] * 7))
                    else:
                        rows.append((path, "record", a, b, None, *(one[k] for k in names[5:])))
                        held += one["bytes"] or 0
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return t.map_arrow(archives.select("path", "content"), run, "path string, kind string, start long, end long, reason string, type string, id string, url string, refers_to string, payload binary, bytes long, digest string")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, written to archives and read back."""
    archives = write(t.table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    found = read(archives).where("kind = 'record'")
    return found.select(number("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN r ON p.n >= 1000 AND p.digest = r.digest
"""
