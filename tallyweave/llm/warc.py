"""WARC archives: deduplicating writer and a reader that salvages what it can.

Archives are plain WARC 1.1 files of UTF-8 records, written by Spark's text writer to any file system Spark knows.  The
reader also takes gzip members.  A record counts only if its frame, length and digests agree.  After one that doesn't,
the reader looks for the next version line or gzip member that opens a valid record; the bytes between are logged as a
gap.  What a gzip member decompresses to is read in the same way, so damage to one of its records costs that record only,
and of a member that breaks the records before the break are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batches, byte_texts, only, store

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records of one file at most; a file is read whole by one task.
RECORDS_PER_FILE, FILE_BYTES = 2000, 32 << 20
#: Bits that tell which digests are shared, 2 MB; any number of at least 32768 gives the same archives.
SHARED_BITS = 1 << 24
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def sha1(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, payload_sha1: str | None = None) -> bytes:
    """One record without the two line ends that follow it."""
    digest = payload_sha1 or sha1(payload)
    block = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place and where it ends; ValueError says which check failed."""
    stop = data.find(b"\r\n\r\n", at)
    if not _START.match(data, at) or data[at : at + 2] == b"\x1f\x8b":
        raise ValueError("no version line")
    if stop < 0:
        raise ValueError("header without end")
    try:
        lines = data[at:stop].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        raise ValueError("header is not UTF-8") from None
    fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    head = dict(fields)
    if len(head) < len(fields) or not all(":" in x for x in lines):  # a header that runs into the next one
        raise ValueError("malformed header")
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        raise ValueError("no length")
    if not (head.get("warc-type") and head.get("warc-record-id") and head.get("warc-date")):
        raise ValueError("a mandatory field is missing")
    end = stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length and end disagree")
    block = data[stop + 4 : end]
    if head.get("warc-block-digest", sha1(block) if "warc-block-digest" not in head else "").removeprefix("sha1:") != sha1(block):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") == "revisit":
        said = re.search(rb"\r\nContent-Length: *([0-9]+)", http)
        size = int(said[1]) if said else 0
    else:
        size = len(payload)
        if digest and digest != sha1(payload):
            raise ValueError("payload digest differs")
    return head | {"payload": payload, "payload_bytes": size, "payload_digest": digest or sha1(payload)}, end + 4


Found = Iterator[tuple[int, int, dict | None, str | None]]


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at a place decompresses to, where it ends, and the error that ended it; then its end is unknown."""
    unzip, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and end < len(data):
            # Small steps: the one in which the stream breaks gives nothing.
            step = data[end : end + (1 << 10)]
            parts.append(unzip.decompress(step))
            end += len(step) - len(unzip.unused_data)
    except zlib.error as error:
        return b"".join(parts), end, f"gzip: {error}"
    return b"".join(parts), end, None if unzip.eof else "gzip member without end"


def _plain(data: bytes) -> Found:
    """Records and gaps of uncompressed bytes."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            one, end = parse(data, at)
        except ValueError as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, reason
            gap = None
        yield at, end - at, one, None
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, reason


def salvage(data: bytes) -> Found:
    """(offset, length, record, None) for each record, (offset, length, None, reason) for each gap, in order.

    Records of a gzip member have its place, and so have gaps inside it, with the length 0 and their place in what it
    decompresses to in the reason.  Of a member that breaks, what came out before is salvaged: its records have the
    place where it starts and the length 0, and its bytes are a gap.
    """
    at, gap, reason = 0, None, None
    while at < len(data):
        zipped = data[at : at + 2] == b"\x1f\x8b"
        try:
            if zipped:
                plain, end, broken = _member(data, at)
                found = list(_plain(plain))
                if broken and not any(one for _, _, one, _ in found):
                    raise ValueError(broken)
                if found and not broken and not any(one for _, _, one, _ in found):
                    raise ValueError(found[0][3])
            else:
                (one, end), broken = parse(data, at), None
                found = [(at, end - at, one, None)]
        except ValueError as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, reason
            gap = None
        for place, size, one, why in found:
            if one is not None:
                yield at, 0 if broken else end - at, one, None
            elif not broken or place + size < len(plain):  # the last gap of a broken member is the break itself
                yield at, 0, None, f"bytes {place} to {place + size} of a gzip member: {why}"
        if broken:
            gap, reason = at, broken
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
        else:
            at = end
    if gap is not None:
        yield gap, len(data) - gap, None, reason


def write(pages: DataFrame, id_col: str, url_col: str, html_col: str, path: str, least: int = 0, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write an archive folder: a record for each row, payload the UTF-8 of its html (null: empty).

    Of rows with equal payloads of at least ``least`` bytes those with the smallest id are responses, the others
    revisits of them; rows that repeat the smallest id are all responses, and a null id is larger than any other.
    Payloads meet by SHA-1; a payload that many rows share is grouped in part before it is shuffled, and the join back
    to the rows is one whose large keys Spark splits.  Only rows whose payload may be shared are shuffled: a bitmap of
    fixed size, broadcast, has a bit for each shared digest.  A file holds at most ``per_file`` records and ``file_bytes``
    bytes, or one longer record; it is one row of what Python returns, so the bound holds however sizes are spread.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = only(pages, id=id_col, url=url_col, html=html_col).withColumn("html", html)
    rows = rows.withColumn("sha", F.sha1(F.col("html"))).withColumn("spot", F.pmod(F.xxhash64("sha"), F.lit(SHARED_BITS)) + 1)
    long = rows.where(F.octet_length("html") >= least).groupBy("sha", "spot").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = store(long.where("n > 1").select("sha", "spot", "first", F.lit(True).alias("known")), "warc-shared")
    pieces = first.groupBy(F.bitmap_bucket_number("spot").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    at = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("piece", F.bitmap_bucket_number("spot")).join(F.broadcast(pieces), "piece", "left")
    marked = marked.withColumn("shared", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(spot) % 8 as int))")) != 0, F.lit(False)))
    alone = marked.where(~F.col("shared")).select("id", "url", "html", F.lit(None).cast(rows.schema["id"].dataType).alias("first"), F.lit(False).alias("again"))
    shared = marked.where("shared").select("id", "url", "html", "sha").join(first.drop("spot"), "sha", "left").select(
        "id", "url", "html", "first", (F.col("known") & ~F.col("id").eqNullSafe(F.col("first"))).alias("again")
    )
    ready = alone.unionByName(shared)

    def file(records: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.join(records)], pa.string())], names=["value"])

    def run(batches: Batches) -> Batches:
        out: list[str] = []
        size = 0
        for batch in batches:
            pages = zip(*(batch.column(c).to_pylist() for c in ("id", "url", "first", "again")), byte_texts(batch.column("html")), strict=True)
            for i, url, first, again, payload in pages:
                raw = record(i, url, payload, first, bool(again))
                if out and (size + len(raw) > file_bytes or len(out) == per_file):
                    yield file(out)
                    out, size = [], 0
                out.append(raw.decode())
                size += len(raw) + len(END)
        if out:
            yield file(out)

    ready.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


FIELDS = (
    ("archive", pa.string(), "string"), ("offset", pa.int64(), "bigint"), ("length", pa.int64(), "bigint"), ("gap", pa.string(), "string"),
    ("record_id", pa.string(), "string"), ("record_type", pa.string(), "string"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "bigint"),
    ("payload_digest", pa.string(), "string"), ("refers_to", pa.string(), "string"), ("payload", pa.binary(), "binary"),
)


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """FIELDS of every record and every quarantined gap below a folder.

    A gap has its reason in ``gap`` and no record; offset and length are bytes of the file, see ``salvage``.  An empty folder gives an
    empty result.  ``payloads`` False leaves the payloads out.
    """
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out: list[tuple] = []
                give = lambda some: pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, (_, k, _) in zip(zip(*some, strict=True), FIELDS, strict=True)], names=[f for f, _, _ in FIELDS]
                )
                for at, size, one, reason in salvage(content.as_buffer().to_pybytes()):
                    rest = [None] * 7 if one is None else [
                        one.get("warc-record-id"), one.get("warc-type"), one.get("warc-target-uri"), one["payload_bytes"], one["payload_digest"],
                        one.get("warc-refers-to"), one["payload"] if payloads else None,
                    ]
                    out.append((name.as_py(), at, size, reason, *rest))
                    if len(out) == 256:
                        yield give(out)
                        out = []
                if out:
                    yield give(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{f} {k}" for f, _, k in FIELDS))


def page_of(urn):
    """The page id in a column of record names."""
    return F.regexp_extract(urn, r"<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to a folder, read it back: one row per page with payload size and digest."""
    write(pages, "page_id", "url", "html", path)
    found = read(pages.sparkSession, path, payloads=False).where("gap IS NULL")
    return found.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")
    )
