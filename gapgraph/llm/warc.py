"""WARC archives: a writer with revisit records and a reader that salvages damaged archives."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapgraph.llm.common import compact, part_count, slices

#: Payloads of at least this many bytes are written once.
REVISIT_BYTES = 100
#: Records of one archive file.
FILE_RECORDS = 5000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(re.escape(_MEMBER) + b"|" + _VERSION.pattern)
_STEP = 1 << 14
#: A gzip member of no bytes; it ends in a zero byte, as every member of under 16 MiB does.
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()

RECORD = "archive string, offset long, length long, status string, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def record_name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit (``refers_to`` set) carries the HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"] if refers_to else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The header fields of a record that starts at ``at``, and where its block starts."""
    version = _VERSION.match(data, at)
    end = data.find(b"\r\n\r\n", at) if version else -1
    if end < 0:
        return None
    fields = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def digest_agrees(labelled: str, data: bytes) -> bool:
    """Whether data has the digest ``algorithm:value``, in hexadecimal or base 32; True if the algorithm isn't known."""
    kind, _, value = labelled.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5") or not value:
        return True
    digest, value = hashlib.new(kind, data).digest(), value.strip()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _check(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """A whole valid record at ``at`` (fields, block, end), or what is wrong with it."""
    head = _headers(data, at)
    if head is None:
        return "no record head"
    fields, start = head
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
        return "a required field is missing"
    end = start + int(fields["content-length"])
    if end > len(data):
        return "the block is cut off"
    if data[end : end + 4] != b"\r\n\r\n":
        return "no record end after the block"
    block = data[start:end]
    if not digest_agrees(fields.get("warc-block-digest", ""), block):
        return "the block digest differs"
    return fields, block, end + 4


def _plain(data: bytes) -> Iterator[tuple[int, int, str, dict | None, bytes | None]]:
    """(start, end, status, fields, block) of each record and each quarantined gap, in order."""
    at, bad, why = 0, None, ""
    while at < len(data):
        found = _check(data, at)
        if not isinstance(found, str):
            if bad is not None:
                yield bad, at, why, None, None
                bad = None
            fields, block, end = found
            yield at, end, "ok", fields, block
            at = end
            continue
        if bad is None:
            bad, why = at, found
        nxt = _VERSION.search(data, at + 1)
        at = nxt.start() if nxt else len(data)
    if bad is not None:
        yield bad, len(data), why, None, None


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` inflates to, and its end; of a broken member what comes before the fault, and None."""
    z, plain, read = zlib.decompressobj(31), [], at
    try:
        while read < len(data) and not z.eof:
            # in steps, for what stands after the member is copied with each
            plain.append(z.decompress(data[read : read + _STEP]))
            read = min(read + _STEP, len(data))
    except zlib.error:
        # a step that fails gives nothing: up to it once more, then byte by byte
        z = zlib.decompressobj(31)
        plain = [z.decompress(data[k : k + _STEP]) for k in range(at, read, _STEP)]
        try:
            for k in range(read, min(read + _STEP, len(data))):
                plain.append(z.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(plain), None
    return b"".join(plain), read - len(z.unused_data) if z.eof else None


def _payload_agrees(fields: dict[str, str], block: bytes) -> bool:
    """Whether a record's payload has the digest in its head, which the block digest doesn't cover; True if that can't be told."""
    return fields["warc-type"] == "revisit" or digest_agrees(fields.get("warc-payload-digest", ""), _payload(fields, block))


def salvage(data: bytes) -> Iterator[tuple[int, int, str, dict | None, bytes | None]]:
    """All records of a plain, gzipped or mixed archive and all byte gaps that hold none.

    After a failed check the search goes on for the next valid gzip member or version line, so one
    broken record costs itself only. Of a broken member the whole valid records that can be inflated are
    kept if their payload digests agree too, and the member is a gap as well. A valid
    member without a valid record is part of a gap that it stands in. Positions are bytes of the
    archive as stored; records of one member have the member's.
    """
    at, bad, why, held = 0, None, "", []

    def gap(end: int):
        if bad is not None:
            yield from ((bad, end, "ok", fields, block) for fields, block in held)
            yield bad, end, why, None, None

    while at < len(data):
        if data.startswith(_MEMBER, at):
            plain, end = _inflate(data, at)
            rows = list(_plain(plain))
            valid = [(fields, block) for _, _, status, fields, block in rows if status == "ok"]
            if end is None:
                valid = [x for x in valid if _payload_agrees(*x)]
            if end is not None and (valid or bad is None):
                yield from gap(at)
                yield from ((at, end, *row[2:]) for row in rows)
                at, bad, held = end, None, []
                continue
            if end is not None:
                at = end
            elif valid or bad is None:
                yield from gap(at)
                bad, why, held = at, "broken gzip member", valid
        else:
            found = _check(data, at)
            if not isinstance(found, str):
                yield from gap(at)
                fields, block, end = found
                yield at, end, "ok", fields, block
                at, bad, held = end, None, []
                continue
            if bad is None:
                bad, why = at, found
            end = None
        nxt = _START.search(data, at if end is not None else at + 1)
        at = nxt.start() if nxt else len(data)
    yield from gap(len(data))


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    if "application/http" in fields.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes a gzipped WARC record per row under ``path``, each in a member of its own.

    Of rows with equal payloads of ``revisit_bytes`` or more the smallest id is the response and the
    others revisit it. Rows that repeat that id with that payload are responses too; a null id is
    larger than any and a group of null ids only is all response. A null payload is empty. The
    digest is computed where a row is read; only digests that occur twice or more are joined back,
    and Spark splits the rows of a hot digest.
    """
    rows = compact(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = rows.filter(F.octet_length("html") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(firsts.filter("n > 1").drop("n"), "digest", "left")

    def run(batches):
        for batch in slices(batches):
            out = []
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = record_name(first) if first is not None and first != page_id else None
                member = gzip_member(build_record(page_id, url, html.encode(), digest, refers))
                # the writer ends each row with the zero byte that every member ends with
                out.append((member if member[-1] == 0 else member + _EMPTY)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    parts = part_count(pages)
    members = joined.select("page_id", "url", "html", "digest", "first_id").mapInArrow(run, "value binary")
    members = members if parts is None else members.coalesce(parts)
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``, and one per quarantined gap.

    status is "ok" or the failed check of a gap, whose other fields are null. Digest and length are
    those of the payload read; a revisit has its header's digest and a null length.
    """

    def run(batches):
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for start, end, status, fields, block in salvage(content.as_py()):
                    row = [path_, start, end - start, status] + [None] * 7
                    if fields is not None:
                        row[4:8] = fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri")
                        if fields["warc-type"] == "revisit":
                            row[8] = fields.get("warc-payload-digest", "").rpartition(":")[2]
                        else:
                            payload = _payload(fields, block)
                            row[8], row[9], row[10] = hashlib.sha256(payload).hexdigest(), len(payload), payload if with_payload else None
                    out.append(row)
                types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
                names = [c.split()[0] for c in RECORD.split(", ")]
                for i in range(0, len(out), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 500], strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)


def quarantine(records: DataFrame) -> DataFrame:
    """(archive, offset, length, reason): the byte gaps of read_archives() that hold no valid record."""
    return records.filter("status <> 'ok'").select("archive", "offset", "length", F.col("status").alias("reason"))


def resolve(records: DataFrame) -> DataFrame:
    """Per valid record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes its length from the record it refers to.

    Gaps are in quarantine(). A revisit whose target is lost, or has another payload, has a null length; a
    name that is no page's gives a null id; repeated records give a row each; no records give none.
    """
    def number(c):
        return F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")

    ok = records.filter("status = 'ok'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))
    lengths = ok.filter("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    target = lengths.select(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_digest"), "_bytes")
    joined = ok.join(target, (ok.refers_to == target._to) & (ok.payload_digest == target._digest), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
