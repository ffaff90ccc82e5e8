"""WARC archives: a writer through Spark's own file output, and a salvage reader.

Records are gzip members of their own, so that a damaged stretch costs the records it touches and
no others. The reader checks each member or record; where a check fails it searches for the next
valid gzip member or version line, recovers what follows, and logs the bytes passed over as a gap.
Within a member's content, that of a damaged one as far as it can be read, it searches likewise.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, trim

#: The empty gzip member (fixed bytes of the format). Text output ends each row with it, so that a
#: file is a clean run of members and needs no separator that is not gzip.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r?\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never stored as revisits.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
#: Digests of repeated payloads (64 characters and an id each) up to which they are broadcast.
BROADCAST_ROWS = 300_000

RECORD_FIELDS = ["offset", "length", "version", "type", "record_id", "headers", "payload", "digest_ok"]


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: "%%%02X" % ord(m[0]), value)


def record_bytes(record_id: str, url: str | None, payload: bytes, kind: str, digest: str, refers_to: str | None, total: int) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
    lines += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {total}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the offset after it; ValueError says what is wrong."""
    m = VERSION_LINE.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise ValueError("header without end")
    headers: dict[str, str] = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise ValueError("bad header line")
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise ValueError("bad content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record end missing")
    block = data[start:stop]
    kind, said = headers.get("warc-type", ""), headers.get("warc-payload-digest", "")
    good = None
    if said.startswith("sha256:") and kind != "revisit":
        good = hashlib.sha256(block).hexdigest() == said[7:].lower()
        if not good:
            raise ValueError("payload digest differs")
    return {"version": m[0].split(b"/")[1].strip().decode(), "type": kind, "record_id": headers.get("warc-record-id", ""), "headers": headers, "payload": block, "digest_ok": good}, stop + 4


def _member_at(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and the offset after it, its checksum verified."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not z.eof:
        raise ValueError("gzip: truncated member")
    return out, len(data) - len(z.unused_data)


def _readable(data: bytes, at: int) -> tuple[bytes, int]:
    """What can be decompressed of a damaged gzip member at ``at``, and the offset up to which it was read."""
    z, out, step = zlib.decompressobj(31), [], 4096
    while at < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            z, step = before, 1
            continue
        at += step
    return b"".join(out), min(at, len(data))


def _records(content: bytes) -> Iterator[tuple[str, dict]]:
    """("record", ...) and ("gap", ...) within decompressed content, in order, with inner_offset and inner_length."""
    at, bad, why = 0, -1, ""
    while at < len(content):
        try:
            record, after = _parse_record(content, at)
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            line = VERSION_LINE.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if bad >= 0:
            yield "gap", {"inner_offset": bad, "inner_length": at - bad, "reason": why}
            bad = -1
        yield "record", {"inner_offset": at, "inner_length": after - at, **record}
        at = after
    if bad >= 0:
        yield "gap", {"inner_offset": bad, "inner_length": at - bad, "reason": why}


def salvage(data: bytes) -> Iterator[tuple[str, dict]]:
    """("record", ...) and ("gap", {offset, length, reason}) in file order.

    Offsets are those of the archive's bytes; a record or gap within a member has its member's, and
    its own place in the decompressed content as inner_offset and inner_length. Of a damaged member
    the readable part is searched too: what parses there comes with the damage as its reason, since
    no checksum vouches for it, at the offset and length of the gap that follows. Nothing is dropped
    silently: records and gaps together, with empty members, cover the whole file.
    """
    at, bad, why, n = 0, -1, "", len(data)
    rescued: list[tuple[str, dict]] = []  # from the readable part of the damaged member at ``bad``
    read_to = 0

    def closed(upto: int) -> list[tuple[str, dict]]:
        if bad < 0:
            return []
        place = {"offset": bad, "length": upto - bad}
        return [(kind, {"reason": why, **place, **x}) for kind, x in rescued] + [("gap", {**place, "reason": why})]

    while at < n:
        packed = data.startswith(GZIP_MAGIC, at)
        try:
            if packed:
                # a window that grows: decompressing never copies the rest of a large archive for each member
                width = 1 << 16
                while True:
                    try:
                        content, used = _member_at(data[at : at + width], 0)
                        break
                    except ValueError as e:
                        if "truncated" not in str(e) or at + width >= n:
                            raise
                        width *= 4
                after = at + used
                found = list(_records(content))
                if content and all(kind == "gap" for kind, _ in found):
                    raise ValueError(found[0][1]["reason"])
            else:
                record, after = _parse_record(data, at)
                found = [("record", record)]
        except ValueError as e:
            if packed and str(e).startswith("gzip"):
                content, upto = _readable(data, at)
                parts = list(_records(content))
                if any(kind == "record" for kind, _ in parts):
                    yield from closed(at)
                    bad, why, rescued, read_to = at, str(e), parts, upto
            if bad < 0:
                bad, why = at, str(e)
            line = VERSION_LINE.search(data, at + 1)
            member = data.find(GZIP_MAGIC, at + 1)
            at = min(line.start() if line else n, member if member >= 0 else n)
            continue
        if not packed and at < read_to and any(record.items() <= x.items() for _, x in rescued if "headers" in x):
            at = after  # stored without compression in the damaged member: it has been read
            continue
        yield from closed(at)
        bad, rescued, read_to = -1, [], 0
        for kind, x in found:
            yield kind, {"offset": at, "length": after - at, **x}
        at = after
    yield from closed(n)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    The first holder of a payload (smallest page_id) is found by an aggregate that combines before
    the shuffle. Up to BROADCAST_ROWS repeated payloads their digests are broadcast, so no payload is
    shuffled and one with very many copies is no hot key; beyond that digests are joined, and then
    pages by their id. Repeated rows of one page_id each keep a row; a null page_id refers to none.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select("page_id", "url", html.alias("payload"))
    facts = pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("bigint").alias("payload_bytes"))
    first = facts.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = materialize(first, "warc-first")
    digested = full.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    if first.count() <= BROADCAST_ROWS:
        held = digested.join(F.broadcast(first), "payload_digest", "left")
        refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    else:
        copies = facts.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("copy_id"), F.col("payload_digest").alias("copy_digest"), "first_id").distinct()
        held = digested.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("payload_digest") == F.col("copy_digest")), "left")
        refers = F.col("first_id")
    return held.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), refers.alias("refers_to"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the records of :func:`mark_revisits` as gzip-per-record archives below ``path``.

    Spark's text output carries the bytes, so any file system that Spark can write will do and a
    retried task leaves no partial file. A task counts the bytes it writes and begins another archive,
    in a folder of its own number, with the record after ``archive_bytes``, however long records are.
    """
    schema = "value binary, volume int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                out, volumes = [], []
                for r in whole.slice(begin, 64).to_pylist():
                    out.append(gzip_member(record_bytes("null" if r["page_id"] is None else str(r["page_id"]), r["url"], r["payload"], r["record_type"], r["payload_digest"], r["refers_to"], r["payload_bytes"])))
                    volumes.append(written // archive_bytes)
                    written += len(out[-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(volumes, pa.int32())], ["value", "volume"])
        trim()

    raw = records.mapInArrow(run, schema).select(F.col("value").cast("string").alias("value"), "volume")
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).partitionBy("volume").text(path)
    return path


def read_archives(spark, path: str, glob: str = "*") -> DataFrame:
    """Salvage every archive below ``path``: kind (record or gap), archive, offset, length, reason,
    type, record_id, headers (map), payload, inner_offset, inner_length. Empty archives give no rows."""
    names = ["kind", "archive", "offset", "length", "reason", "type", "record_id", "headers", "payload", "inner_offset", "inner_length"]
    schema = "kind string, archive string, offset long, length long, reason string, type string, record_id string, headers map<string,string>, payload binary, inner_offset long, inner_length long"
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.int64()]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, held = [], 0
                for kind, x in salvage(content.as_py()):
                    rows.append([kind, archive.as_py(), x["offset"], x["length"], x.get("reason"), x.get("type"), x.get("record_id"), list(x["headers"].items()) if "headers" in x else None, x.get("payload"), x.get("inner_offset"), x.get("inner_length")])
                    held += len(x.get("payload", b""))
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, schema)


def quarantined(rows: DataFrame) -> DataFrame:
    """The log of byte gaps: archive, offset, length, reason, inner_offset, inner_length (null: the
    gap is of the archive's own bytes)."""
    return rows.filter("kind = 'gap'").select("archive", "offset", "length", "reason", "inner_offset", "inner_length")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A null html is an empty payload, a null page_id comes
    back null; lengths and digests of responses are taken from the payload read back, those of
    revisits from their headers, which name the full payload."""
    spark = pages.sparkSession
    path = write_archives(mark_revisits(pages), shared_dir(spark, "warc"))
    rows = read_archives(spark, path, "part-*").filter("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as bigint)")
    stored = F.col("type") == "response"
    return rows.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(F.expr("headers['warc-payload-length']").cast("bigint")).cast("bigint").alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.expr("substring(headers['warc-payload-digest'], 8)")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("headers['warc-refers-to']").alias("refers_to"),
    )
