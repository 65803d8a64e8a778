"""WARC archives: writing pages as records, and reading records back with their segments put together.

Writing: a page becomes an HTTP response with chunked transfer framing.  A message over ``SEGMENT`` bytes is cut
into a first record and continuation records, which carry the first one's id, their number, and, on the last, the
total length.  Of pages with equal payloads of some size only the first is written whole; the others are revisit
records that name it.  Each row is a record of its own: of rows with equal ids and payloads one has the plain record
id, and the others add the number of their row to it.  Records are rows of Spark's text sink, whose line separator is the blank lines that end a
record, so files reach any store that Spark writes to, compressed, and a lost task is written again.

Reading: files are cut at the version line that begins each record, so a task holds one record at a time.  Our
own writer parts a chunk inside every such line of a payload; a record of another writer that holds one does not
have its declared length, and reading fails with its id.  Whole records are decoded where they are read;
segments are grouped by their origin's id, put in order of their numbers and checked for gaps and total length.

Defined results: a null page is an empty payload; a page that stands in several rows with equal id and payload is as
many records and as many rows when read, each a response if the first of its payload is among them; a null id is
written as an empty number, never revisits nor is revisited, and is read as null; a revisit of nothing that was read
fails; a very long page is one row, cut into as many segments as it takes; an empty table gives archives without
records and an empty one when read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch

VERSION = "WARC/1.1"
SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Payloads below so many bytes are always written whole.
REVISIT_BYTES = 100
#: Revisits are broadcast up to so many rows, of about 100 bytes each.
BROADCAST_ROWS = 100_000
RECORDS_PER_FILE = 20_000


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; no chunk holds a record's version line."""
    out = []
    for part in re.split(b"(?<=WAR)(?=C/1\\.1)", payload):
        for i in range(0, len(part), size):
            piece = part[i : i + size]
            out.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not have its declared length")
        at = end + 4 + size


def http_payload(message: bytes) -> bytes:
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("an HTTP message without end of headers")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def records(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, refers_digest: str | None, segment: int = SEGMENT, copy: int | None = None) -> list[bytes]:
    """The records of one page, without the blank lines that end each; ``copy`` parts rows with equal ids and payloads."""
    own = f"<urn:page:{page_id}:{digest}" + ("" if copy is None else f":copy-{copy}")
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank").replace(VERSION, "WARC%2F1.1"))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own + ">"), *common, ("WARC-Refers-To", f"<urn:page:{refers_to}:{refers_digest}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        return [_record(head, http)]
    message = http + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", own + ">"), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if len(message) <= segment:
        return [_record(head, message)]
    parts = [message[i : i + segment] for i in range(0, len(message), segment)]
    out = [_record([*head, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own}:{n}>"), *common, ("WARC-Segment-Origin-ID", own + ">"), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(message))))
        out.append(_record(more, part))
    return out


def _write(segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page, url, payload, digest, refers, copy = (x.as_py() for x in r)
                payload = payload.encode() if isinstance(payload, str) else payload
                own = records("" if page is None else str(page), url, payload, digest, None if refers is None else str(refers), digest, segment, copy)
                out += own
                size += sum(map(len, own))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    return write


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Writes a record for each row (more, if it is cut into segments).

    Rows are numbered once in a stored copy, as the number is part of a repeated row's record id.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("").cast(pages.schema[payload_col].dataType))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    rows = scratch.stored(rows.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    narrow = rows.select("page", "digest", F.octet_length("payload").alias("n"), "row")
    pages_of = narrow.groupBy("digest", "page").agg(F.max("n").alias("n"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    pages_of = scratch.stored(pages_of, "warc-pages")
    firsts = pages_of.groupBy("digest").agg(F.min("page").alias("first"), F.sum("copies").alias("rows"), F.max("n").alias("size")).filter(f"rows > 1 and first is not null and size >= {REVISIT_BYTES}").select("digest", "first")
    told = pages_of.join(scratch.stored(firsts, "warc-firsts"), "digest", "left")
    refers = F.when(F.col("page") != F.col("first"), F.col("first"))
    told = told.select(F.col("page").alias("p"), F.col("digest").alias("d"), refers.alias("first"), F.when(F.col("copies") > 1, F.col("row")).alias("plain")).filter("first is not null or plain is not null")
    told = scratch.stored(told, "warc-told")
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told.hint("shuffle_hash")
    copy = F.when(F.col("row") != F.col("plain"), F.col("row"))
    typed = rows.join(told, F.col("page").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page", "url", "payload", "digest", "first", copy.alias("copy"))
    text = typed.mapInArrow(_write(segment), "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD_SCHEMA = "record_id string, record_type string, origin string, number int, total long, refers_to string, digest string, target_uri string, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(0):
            raw = x.as_py()
            if not raw:
                continue
            head, _, block = raw.partition(b"\r\n\r\n")
            h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
            length = int(h.get("content-length", -1))
            if block[length:] != b"\r\n\r\n" if length >= 0 else True:
                raise ValueError(f"the record {h.get('warc-record-id')} does not have its declared length")
            number = h.get("warc-segment-number")
            rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-segment-origin-id", h.get("warc-record-id")), number and int(number), h.get("warc-segment-total-length") and int(h["warc-segment-total-length"]), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha256:") or None, h.get("warc-target-uri"), block[:length]))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path`` with the headers that matter and their blocks."""
    lines = spark.read.option("lineSep", VERSION + "\r\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, RECORD_SCHEMA)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for origin, digest, parts in zip(*(batch.column(i) for i in range(3)), strict=True):
            parts = sorted({x["number"]: x for x in parts.as_py()}.items())
            message = b"".join(x["block"] for _, x in parts)
            if [n for n, _ in parts] != list(range(1, len(parts) + 1)) or parts[-1][1]["total"] != len(message):
                raise ValueError(f"segments of {origin} are missing or do not have their total length")
            yield pa.RecordBatch.from_pydict({"record_id": [origin.as_py()], "digest": [digest.as_py()], "payload": pa.array([http_payload(message)], pa.binary())})


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([http_payload(x.as_py()) for x in batch.column(2)], pa.binary())], names=["record_id", "digest", "payload"])


def responses(found: DataFrame) -> DataFrame:
    """(record_id, digest, payload) of all response records, those in segments put together again."""
    schema = "record_id string, digest string, payload binary"
    whole = found.filter("record_type = 'response' and number is null").select("record_id", "digest", "block").mapInArrow(_decode, schema)
    cut = found.filter("number is not null").groupBy("origin").agg(F.max("digest").alias("digest"), F.collect_list(F.struct("number", "total", "block")).alias("parts"))
    return whole.unionByName(cut.mapInArrow(_join_segments, schema))


def page_of(record_id):
    return F.regexp_extract(record_id, r"<urn:page:(-?\d+):", 1).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page written by ``write_warc``."""
    found = read_records(spark, path)
    decoded = responses(found).select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("digest").alias("declared"))
    decoded = scratch.stored(decoded, "warc-responses")
    wrong = F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("record_id")))
    decoded = decoded.withColumn("payload_digest", F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong)).drop("declared")
    first = decoded.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = found.filter("record_type = 'revisit'").select(F.col("record_id").alias("own"), "refers_to", "digest")
    missing = F.raise_error(F.concat(F.lit("a revisit of a record that is not there: "), F.col("own")))
    later = revisits.join(decoded, F.col("refers_to") == F.col("record_id"), "left").select(
        page_of(F.col("own")).alias("page_id"), F.when(F.col("record_id").isNotNull(), F.col("payload_bytes")).otherwise(missing).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"),
    )
    return first.unionByName(later)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
f as (select page_id, n, sha256(html) as digest, min(page_id) over (partition by html) as first from p)
select page_id, n as payload_bytes, digest as payload_digest, case when n >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and first < page_id then first end as refers_to
from f
"""
