"""WARC archives of pages: segmented, chunked records out; reassembled, verified payloads back.

Archives are written through Spark's own text sink, so they land wherever Spark can write and are committed as a whole:
a lost or repeated task leaves no half record behind. A record is one row whose last line feed is the sink's line
separator; a file is a gzip stream of records. A record block longer than ``SEGMENT`` is split: the first part stays in
its record, the others become ``continuation`` records that name it as origin and bear a segment number, the last of
them the total length.

Reading back, records that are whole are decoded where they are read. Segments alone go through a shuffle: they are
grouped by origin id, put in order, checked for gaps and against the total length, and joined.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.runtime import drop, fresh_path, ship, stage

#: Bytes of a record block, of an HTTP chunk, and records of a file: an archive file holds 512 MB at the very most.
SEGMENT, CHUNK, RECORDS = 64 << 10, 16 << 10, 8192
#: Payloads of at least so many bytes are revisited if they are equal; shorter ones are always stored.
REVISIT_FROM = 0
#: Bytes of output that a reading task holds before it passes them on.
_FLUSH = 4 << 20
#: The date of every record: archives of the same pages are the same bytes.
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_RECORD = "record_id string, kind string, page_id long, refers_to long, digest string, length long, segment int, origin string, total long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body, chunk extensions and trailers skipped; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(value: str | None) -> str:
    """A header value cannot hold a line break."""
    return " ".join((value or "").split())


def page_records(page_id: int | None, url: str | None, payload: bytes, unique: str, refers_to: int | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page."""
    name = lambda k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{unique}/{k}')}>"
    digest = f"sha1:{base32_sha1(payload)}"
    base = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(1)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url))]
    base += [("WARC-Payload-Digest", digest), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        base += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)), ("X-Payload-Length", str(len(payload)))]
        yield _header([*base, ("Content-Length", "0")]) + b"\r\n\r\n"
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    base.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        yield _header([*base, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"
        return
    for k, at in enumerate(range(0, len(block), segment), 1):
        part = block[at : at + segment]
        fields = base if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Segment-Origin-ID", name(1))]
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        yield _header([*fields, ("WARC-Segment-Number", str(k)), *last, ("Content-Length", str(len(part)))]) + part + b"\r\n\r\n"


def _write_records(segment: int):
    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page, url, html, refers, revisit in zip(*(c for c in batch.columns), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                unique = f"{page.as_py()}/{task}/{row}"
                row += 1
                for record in page_records(page.as_py(), url.as_py(), payload, unique, refers.as_py(), revisit.as_py(), segment):
                    out.append(record[:-1])  # the sink adds the last line feed
                    held += len(record)
                if held > _FLUSH:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, segment: int = SEGMENT) -> None:
    """Archives of all rows of ``pages (page_id, url, html)`` below ``path``.

    Of rows with equal payloads of at least ``revisit_from`` bytes those with the largest page_id are responses, the
    others revisit them; null ids count below all others. Rows that tie in both are responses alike.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "utf-8").alias("html"))
    digests = stage(slim.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")), "digests")
    groups = digests.where(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.max("page_id").alias("refers"), F.count("*").alias("n"), F.count("page_id").alias("ids"))
    groups = groups.where("n > 1 and ids > 0")
    repeated = digests.join(groups, ["digest", "size"]).where("page_id is null or page_id < refers")
    # a page with several payloads needs the digest too; this table is empty or small on most crawls, and if it is
    # not, Spark joins it through a shuffle
    repeated = stage(repeated.select("page_id", F.col("digest").alias("d"), "refers").distinct(), "revisits").withColumnRenamed("page_id", "p")
    own = slim.withColumn("d0", F.sha1("html"))
    rows = own.join(repeated, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("d0") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "html", F.col("refers").alias("refers"), F.col("d").isNotNull().alias("revisit"))
    records = rows.mapInArrow(_write_records(segment), "value binary").select(F.expr("cast(value as string)").alias("value"))
    records.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS).text(path)
    drop(digests, repeated)


def parse_records(content: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a byte stream."""
    buffer = bytearray()
    content = iter(content)

    def more() -> bool:
        piece = next(content, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a record header is cut off")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        need = end + 4 + size + 4
        while len(buffer) < need:
            if not more():
                raise ValueError("a record block is cut off")
        block = bytes(buffer[end + 4 : end + 4 + size])
        if buffer[need - 4 : need] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        del buffer[:need]
        yield head, block


def _unzip(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed pieces of a gzip file of one or more members, or of a plain file."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + step]) for i in range(0, len(data), step))
        return
    left = data
    while len(left):
        member = zlib.decompressobj(wbits=31)
        feed = left
        while len(feed) and not member.eof:
            piece = member.decompress(feed[:step])
            feed = feed[step:]
            while piece or member.unconsumed_tail:
                if piece:
                    yield piece
                piece = member.decompress(member.unconsumed_tail, step) if member.unconsumed_tail else b""
        tail = len(member.unused_data)
        left = left[len(left) - len(feed) - tail :] if member.eof else left[len(left) :]


def _number(value: str | None) -> int | None:
    return int(value) if value not in (None, "") else None


def _read_records(batches):
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for head, block in parse_records(_unzip(memoryview(content.as_buffer()))):
                segment, kind = _number(head.get("warc-segment-number")), head["warc-type"]
                page, refers = _number(head.get("x-page-id")), _number(head.get("x-refers-to-page-id"))
                digest, length = head.get("warc-payload-digest", "").removeprefix("sha1:"), _number(head.get("x-payload-length"))
                origin = head.get("warc-segment-origin-id", head["warc-record-id"]) if segment is not None else None
                rows.append((head["warc-record-id"], kind, page, refers, digest, length, segment, origin, _number(head.get("warc-segment-total-length")), block))
                held += len(block)
                if held > _FLUSH:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, one row each."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read_records, _RECORD)


def payload_of(block: bytes) -> tuple[bytes | None, str]:
    """Payload of an HTTP response block and what is wrong with it, if anything."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None, "no http header"
    body = block[end + 4 :]
    if b"transfer-encoding: chunked" in block[:end].lower():
        body = dechunk(body)
        return body, "ok" if body is not None else "broken chunk framing"
    return body, "ok"


_DECODED = "record_id string, page_id long, refers_to long, record_type string, payload_bytes long, payload_digest string, status string, payload binary"


def _decode(keep_payload: bool):
    """Rows (record_id, kind, page_id, refers_to, digest, length, block, problem) to what they archive."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for name, kind, page, refers, digest, length, block, problem in zip(*batch.columns, strict=True):
                head = (name.as_py(), page.as_py(), refers.as_py(), kind.as_py())
                if head[3] == "revisit":
                    out.append((*head, length.as_py(), digest.as_py(), "ok", None))
                    continue
                payload, status = (None, problem.as_py()) if problem.is_valid else payload_of(block.as_buffer().to_pybytes())
                found = base32_sha1(payload) if payload is not None else None
                if found is not None and digest.as_py() != found:
                    status = "payload digest differs"
                held += len(payload or b"")
                out.append((*head, None if payload is None else len(payload), found, status, payload if keep_payload else None))
                if held > _FLUSH:
                    yield _decoded(out)
                    out, held = [], 0
            if out:
                yield _decoded(out)

    return run


def _decoded(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _DECODED.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def reassemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per origin: ``(record_id, page_id, refers_to, record_type, payload_bytes, payload_digest, status, payload)``.

    ``records`` is what ``read_records`` gives, in any order and from any number of files. ``status`` is ok, or says why a
    payload could not be verified: a missing or repeated segment, no last segment, a wrong total length, broken chunk
    framing or a digest that differs. Digest and length are those of the payload found; of a revisit, those it names.
    A continuation without its origin record keeps the origin's id and has no page.
    """
    whole = records.where("segment is null").select("record_id", "kind", "page_id", "refers_to", "digest", "length", "block", F.lit(None).cast("string").alias("problem"))
    parts = records.where("segment is not null")
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block", "total", "kind", "page_id", "digest")))
    groups = parts.groupBy("origin").agg(ordered.alias("s"))
    first = F.get("s", F.lit(0))
    numbers = F.transform("s", lambda x: x["segment"])
    total = F.get("s", F.size("s") - 1)["total"]
    size = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    problem = (
        F.when(~numbers.eqNullSafe(F.sequence(F.lit(1), F.size("s"))), "segments missing or repeated")
        .when(total.isNull(), "no last segment")
        .when(total != size, "total length differs")
    )
    joined = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), ""))
    again = groups.select(
        F.col("origin").alias("record_id"),
        F.when(first["segment"] == 1, first["kind"]).otherwise("response").alias("kind"),
        first["page_id"].alias("page_id"),
        F.lit(None).cast("long").alias("refers_to"),
        first["digest"].alias("digest"),
        F.lit(None).cast("long").alias("length"),
        F.when(problem.isNull(), joined).alias("block"),
        problem.alias("problem"),
    )
    return whole.unionByName(again).mapInArrow(_decode(keep_payload), _DECODED)


def archive_round_trip(pages: DataFrame, revisit_from: int = REVISIT_FROM, segment: int = SEGMENT) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and reads them back: one row per page.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, status)``. Null html is an empty payload, a null
    url an empty target. Null ids come back as null. Repeated rows come back as often as they came in. An empty table
    gives no rows; columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, revisit_from, segment)
    found = reassemble(read_records(spark, path), keep_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def _base32_sql(digits: str) -> str:
    """SQL of the base32 form of 40 hex digits."""
    value = lambda i: f"CAST('0x' || substr({digits}, {1 + i * 5 // 4}, 2) AS INTEGER)"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({value(i)} // {1 << 3 - i * 5 % 4}) % 32, 1)" for i in range(32))


#: The same rows from the table itself.
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages
), d AS (
  SELECT *, sha1(payload) AS digits FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_base32_sql("digits")} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to, 'ok' AS status
FROM d
"""
