"""Web archives: a writer of compressed WARC records, and a reader that salvages damaged files.

Writing. A payload's first record (that with the smallest id) is a response, later
ones are revisit records that refer to it. Only digests and ids are grouped; pages
are not, and the pages that revisit are joined back by broadcast where their table
is small and by a shuffle otherwise. Each record is a gzip member of its own. Tasks
write through Spark's text writer, so that files are committed like any other output
on any store: a row is a run of whole members less its last byte, a zero, which the
line separator puts back.

Reading. Files come from Spark's binary reader. A member is taken when it inflates,
its checksum holds and its records parse with the lengths and digests that they
state. After a failure the reader looks for the next gzip member or version line
from which a whole valid record can be read, goes on there, and gives a row of kind
``gap`` with the bytes between. Of a member that breaks off the records before the break are
kept, of one with a damaged record within the others; the gap then names the member's bytes,
and ``reason`` those of its content. Every mark is searched for once, so time is linear
in the file's size however many places are damaged.

Defined results: null payloads count as empty, null urls as an empty target; equal
payloads under the same smallest id are all responses; a null id is written as an
empty id, read back as null and never referred to unless all are null; ids are
percent-encoded in record ids, line breaks in targets; a revisit stays one when the record
that it refers to is lost; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._store import new_path, size_of, staged

#: Tables of revisits up to this size are broadcast.
BROADCAST_BYTES = 64 << 20
#: About the bytes of one row of archive, many records or one large one.
RUN_BYTES = 4 << 20
#: Parts that the pages of one payload are dealt over.
SALTS = 32
VERSION = b"WARC/1.1\r\n"
MAGIC, MARK = b"\x1f\x8b\x08", b"WARC/1."
READ_SCHEMA = "kind string, path string, start long, stop long, record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes at any time and place."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = member(b"")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or with ``refers_to`` a revisit, which has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{quote(record_id)}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head.insert(2, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.insert(3, ("WARC-Refers-To", f"<urn:page:{quote(refers_to)}>"))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, sha, refers_to) of the records that repeat another's payload."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    # a payload that very many pages have is dealt by salt
    salt = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(SALTS))
    keys = staged(
        pages.where(F.octet_length(payload) >= min_bytes).select(F.col(id_col).alias("_warc_id"), F.unhex(F.sha2(payload, 256)).alias("_warc_sha"), salt.alias("_warc_salt")),
        "payloads",
    )
    parts = keys.groupBy("_warc_sha", "_warc_salt").agg(F.min("_warc_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    firsts = parts.groupBy("_warc_sha").agg(F.min("refers_to").alias("refers_to"), F.sum("n").alias("n")).where("n > 1")
    told = parts.select("_warc_sha", "_warc_salt").join(firsts, "_warc_sha")
    again = keys.join(told, ["_warc_sha", "_warc_salt"]).where("_warc_id is null or _warc_id > refers_to")
    return staged(again.select("_warc_id", "_warc_sha", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` to files under ``path``."""
    again = revisits(pages, id_col, payload_col, min_bytes)
    again = F.broadcast(again) if size_of(again) <= BROADCAST_BYTES else again
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), payload.cast("binary").alias("payload"))
    joined = rows.join(again, rows["id"].eqNullSafe(again["_warc_id"]) & (F.unhex(F.sha2("payload", 256)) == again["_warc_sha"]), "left")
    rows = joined.select(F.col("id").cast("string"), "uri", "payload", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            data = b"".join(members)
            data = data if data.endswith(b"\0") else data + EMPTY_MEMBER  # the last byte is the length's highest
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["members"])

        for batch in batches:
            for i in range(batch.num_rows):
                rid, uri, body, to = (batch.column(k)[i].as_py() for k in range(4))
                members.append(member(record(rid or "", uri, body, to)))
                size += len(members[-1])
                if size >= RUN_BYTES:
                    yield row()
                    members, size = [], 0
        if members:
            yield row()

    rows.mapInArrow(run, "members binary").select(F.col("members").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class Damaged(ValueError):
    pass


class _Next:
    """The next place of a mark at or after a byte; asked in ascending order, a mark costs one pass in all."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def __call__(self, mark: bytes, start: int) -> int:
        asked, found = self.known.get(mark, (0, -1))
        if not asked <= start <= found:
            found = self.data.find(mark, start)
            found = len(self.data) if found < 0 else found
            self.known[mark] = start, found
        return found


def _inflate(data: bytes, at: int, find: _Next) -> tuple[bytes, int, str | None]:
    """One member's content, or as much as it gives, where it ends, and what is wrong with it."""
    flags = data[at + 3] if at + 3 < len(data) else 0xE0
    if flags & 0xE0 or (flags & 0x18 and find(b"\0", at + 10) - at > 1 << 16):  # a name or comment ends with a zero
        raise Damaged("no gzip header")
    view, d, out, fed, size = memoryview(data), zlib.decompressobj(31), [], at, 256
    while not d.eof:
        if fed >= len(data):
            return b"".join(out), fed, "the member breaks off"
        part, before = view[fed : fed + size], d.copy() if fed > at else None
        try:
            out.append(d.decompress(part))
        except zlib.error as e:
            for k in range(0, len(part) if before else 0, 256):  # up to the error, nearly
                try:
                    out.append(before.decompress(part[k : k + 256]))
                except zlib.error:
                    break
            return b"".join(out), fed, str(e)
        fed, size = fed + len(part), min(2 * size, 65536)
    return b"".join(out), fed - len(d.unused_data), None


def _parse(data: bytes, at: int, find: _Next) -> tuple[dict, int]:
    """The record at a version line, checked, and where it ends."""
    end = find(b"\r\n\r\n", at)
    # a header is as long as its values are, but has one version line
    if not data.startswith(MARK, at) or end == len(data) or find(b"\n" + MARK, at + 1) < end:
        raise Damaged("no record header")
    view = memoryview(data)
    lines = data[at:end].split(b"\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
    start = end + 4
    if not head.get("content-length", "").isdigit():
        raise Damaged("no length")
    stop = start + int(head["content-length"])
    if bytes(view[stop : stop + 4]) != b"\r\n\r\n":
        raise Damaged("the record's length is wrong")
    block = bytes(view[start:stop])
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != base32_sha1(block):
        raise Damaged("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    if not head.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    n = len(payload)
    kind, want = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        for line in http.split(b"\r\n"):
            if line.lower().startswith(b"content-length:") and line[15:].strip().isdigit():
                n = int(line[15:])
    else:
        have = base32_sha1(payload)
        if want and want != have:
            raise Damaged("the payload's digest is wrong")
        want = have
    return {
        "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "record_type": kind,
        "refers_to": head.get("warc-refers-to"), "payload_bytes": n, "payload_digest": want, "payload": payload,
    }, stop + 4


def _plain(data: bytes) -> Iterator[dict]:
    """Records and gaps of bytes that aren't compressed, in order."""
    find, at, bad, why = _Next(data), 0, None, ""
    while at < len(data):
        try:
            r, stop = _parse(data, at, find)
        except Damaged as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            at = find(MARK, at + 1)
            continue
        if bad is not None:
            yield {"kind": "gap", "start": bad, "stop": at, "reason": why}
            bad = None
        yield {"kind": "record", "start": at, "stop": stop} | r
        at = stop
    if bad is not None:
        yield {"kind": "gap", "start": bad, "stop": len(data), "reason": why}


def salvage(data: bytes | memoryview) -> Iterator[dict]:
    """Records and gaps of an archive's bytes, in order."""
    data = bytes(data)
    find, at, bad, why = _Next(data), 0, None, ""
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                content, stop, wrong = _inflate(data, at, find)
                found = [r for r in _plain(content) if not wrong or r["kind"] == "record"]
            else:
                (r, stop), wrong = _parse(data, at, find), None
                found = [{"kind": "record"} | r]
        except Damaged as e:
            found, wrong = [], str(e)
        if bad is not None and (found or not wrong):
            yield {"kind": "gap", "start": bad, "stop": at, "reason": why}
            bad = None
        for r in found:
            within = {"reason": f"{r['reason']}: bytes {r['start']} to {r['stop']} of the member's content"} if r["kind"] == "gap" else {}
            yield r | within | {"start": at, "stop": stop}
        if not wrong:
            at = stop
            continue
        if bad is None:
            bad, why = at, wrong + (f", after {len(found)} records" if found else "")
        at = min(find(MAGIC, at + 1), find(MARK, at + 1))
    if bad is not None:
        yield {"kind": "gap", "start": bad, "stop": len(data), "reason": why}


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of all files under ``path``: the columns of READ_SCHEMA.

    A file is read by one task. The writer's files are as large as its input splits
    (``spark.sql.files.maxPartitionBytes``); Spark's reader takes files of up to 2 GB.
    """
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            for i in range(batch.num_rows):
                found: list[dict] = []
                size = 0
                for r in salvage(memoryview(batch.column(1)[i].as_buffer())):
                    for k in ("record_id", "refers_to"):
                        if r.get(k):
                            r[k] = unquote(re.sub(r"^<urn:page:|>$", "", r[k])) or None
                    size += len(r.get("payload", b"")) if with_payload else 200
                    found.append(r | {"path": batch.column(0)[i].as_py()} | ({} if with_payload else {"payload": None}))
                    if size > RUN_BYTES:
                        yield pa.RecordBatch.from_pylist(found, schema)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, READ_SCHEMA.split(", "))])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` in the shared folder and give their records as read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(spark, path).where("kind = 'record'").select(
        F.col("record_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"),
    )
