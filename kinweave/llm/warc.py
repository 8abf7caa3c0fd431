"""Web archives: writing pages as WARC records, and putting segmented records together again.

A page is an HTTP response whose body is sent in chunks. A record whose block is longer than a segment
is written as a first segment and continuation records; reading groups the segments by the record
they continue, orders them by number, compares their length with the declared total, and decodes the
chunked framing of the body. Pages with the payload of another page become revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import stage
from kinweave.session import working_folder

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
#: Bytes of a record's block that stay in one segment, and of a body that make one chunk.
SEGMENT_BYTES = 4096
CHUNK_BYTES = 1500
#: Records of one archive at most; with segments of a bounded size this bounds what a task reads at a time.
FILE_RECORDS = 4096
_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body behind chunked framing; extensions and trailers are skipped, broken framing is an error."""
    at, parts = 0, []
    while True:
        end = data.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        digits = data[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("bad chunk size")
        size, at = int(digits, 16), end + 2
        if not size:
            break
        if data[at + size:at + size + 2] != _CRLF:
            raise ValueError("chunk is cut off")
        parts.append(data[at:at + size])
        at += size + 2
    while True:  # trailer fields up to an empty line
        end = data.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunked body has no end")
        if end == at:
            return b"".join(parts)
        at = end + 2


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _CRLF


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """The same for every attempt of the same row, and another for a row that repeats a page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def page_records(
    page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: tuple[int, int] | None = None,
    segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
) -> list[bytes]:
    """The records of one page without the two line ends that close each; it may refer to another (page, row)."""
    name = record_id(page_id, row)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    fields = [("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", _digest(payload)),
              ("Page-ID", "" if page_id is None else page_id)]
    if url:
        fields.insert(1, ("WARC-Target-URI", _clean(url)))
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        return [_headers([("WARC-Type", "revisit"), *fields, kind, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(*refers_to)),
                          ("Page-Refers-To", refers_to[0]), ("Content-Length", len(http))]) + http]
    block = http + chunked(payload, chunk)
    if len(block) <= segment:
        return [_headers([("WARC-Type", "response"), *fields, kind, ("Content-Length", len(block))]) + block]
    out = []
    pieces = [block[i:i + segment] for i in range(0, len(block), segment)]
    for number, piece in enumerate(pieces, 1):
        if number == 1:
            own = [("WARC-Type", "response"), *fields, kind]
        else:
            part = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{number}')}>"
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", part), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name)]
        own.append(("WARC-Segment-Number", number))
        if number == len(pieces) > 1:
            own.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_headers([*own, ("Content-Length", len(piece))]) + piece)
    return out


def write_pages(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_revisit: int = LEAST_REVISIT, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, file_records: int = FILE_RECORDS,
) -> None:
    """Write every row of ``pages`` to archives in ``folder``, each compressed as a whole.

    Of the pages with equal payloads of ``least_revisit`` bytes or more the one with the largest id is
    stored and the others become revisits; a page that repeats with the same id and payload is stored
    each time. Null html is an empty payload; null urls are left out; rows with a null id are stored.
    Other columns are not read. Continuation records follow their first segment at some distance.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id())
    shared = rows.where(F.col("page").isNotNull() & (F.length("payload") >= least_revisit)).groupBy("digest").agg(
        F.max(F.struct("page", "row")).alias("stored"), F.count("*").alias("n")).where("n > 1")
    # the payload travels to the partition of its digest; Spark splits a digest that is hot
    marked = rows.join(shared.select("digest", "stored"), "digest", "left").select(
        "page", "row", "url", "payload",
        *(F.when(F.col("page") < F.col("stored.page"), F.col(f"stored.{c}")).alias(f"stored_{c}") for c in ("page", "row")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, later = [], []
            for page, row, url, payload, target, target_row in batch.itertuples(index=False):
                refers = None if pd.isna(target) else (int(target), int(target_row))
                made = page_records(None if pd.isna(page) else int(page), row, url, bytes(payload), refers, segment, chunk)
                first.append(made[0])
                later += made[1:]
            # the continuations of a batch come after its first segments, last ones first
            yield pd.DataFrame({"record": [r + _CRLF for r in first + later[::-1]]})

    out = marked.mapInPandas(write, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n").option("maxRecordsPerFile", file_records).option("compression", "gzip").text(folder)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive; lengths alone say where a record ends."""
    at = 0
    if content.startswith(b"\x1f\x8b"):
        content = gzip.decompress(content)
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        header = dict(line.split(": ", 1) for line in content[at:end].decode().split("\r\n")[1:] if ": " in line)
        start = end + 4
        length = int(header["Content-Length"])
        if content[start + length:start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield header, content[start:start + length]
        at = start + length + 4


_RECORD = "origin string, kind string, page long, refers long, target string, declared string, number long, total long, block binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record or segment of the archives in ``folder``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda v: int(v) if v else None
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for h, block in parse_archive(bytes(content)):
                    rows.append((h.get("WARC-Segment-Origin-ID") or h["WARC-Record-ID"], h["WARC-Type"], whole(h.get("Page-ID")), whole(h.get("Page-Refers-To")),
                                 h.get("WARC-Refers-To"), h.get("WARC-Payload-Digest"), whole(h.get("WARC-Segment-Number")), whole(h.get("WARC-Segment-Total-Length")), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _typed(rows)
                        rows, held = [], 0
                yield _typed(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(parse, _RECORD)


def _typed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["origin", "kind", "page", "refers", "target", "declared", "number", "total", "block"])
    return out.astype({c: "Int64" for c in ("page", "refers", "number", "total")})


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each record: (origin, kind, page, refers, target, declared, block, problem).

    Only segments are grouped; whole records pass without a shuffle. Segments are ordered by number; a
    repeated segment counts once. ``problem`` is "gap" if a number is missing, "no origin" if the first
    one is, "no end" if no segment declares the total, "length" if the total differs; the block is null then.
    """
    whole = records.where("number is null").select(
        "origin", "kind", "page", "refers", "target", "declared", "block", F.lit(None).cast("string").alias("problem"))
    parts = records.where("number is not null").groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.col("kind"))).alias("kind"), F.max("page").alias("page"), F.max("refers").alias("refers"),
        F.max("target").alias("target"), F.max("declared").alias("declared"), F.max("total").alias("total"), F.max("number").alias("last"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"))
    block = F.expr("cast(array_join(transform(parts, p -> cast(p.block as string)), '') as binary)")
    joined = parts.withColumn("block", block)
    problem = (
        F.when(F.col("parts.number")[0] != 1, "no origin").when(F.size("parts") != F.col("last"), "gap")
        .when(F.col("total").isNull(), "no end").when(F.length("block") != F.col("total"), "length"))
    return whole.unionByName(joined.select(
        "origin", "kind", "page", "refers", "target", "declared", F.when(problem.isNull(), F.col("block")).alias("block"), problem.alias("problem")))


def payloads(records: DataFrame, keep: bool = True) -> DataFrame:
    """(origin, kind, page, refers, target, payload_bytes, payload_digest, problem[, payload]) of whole records.

    The body is freed of its HTTP header and chunks and compared with the digest the record declares:
    "framing" or "digest" is the problem where that fails. Revisits have the declared digest alone.
    """

    @F.pandas_udf("struct<payload:binary,bytes:long,digest:string,problem:string>")
    def opened(blocks: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for block, kind, declared in blocks:
            rows = []
            for data, what, said in zip(block, kind, declared):
                if data is None or what != "response":
                    plain = base64.b32decode(said[5:]).hex() if isinstance(said, str) and said.startswith("sha1:") else None
                    rows.append((None, None, plain, None))
                    continue
                head, _, body = bytes(data).partition(b"\r\n\r\n")
                try:
                    body = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError:
                    rows.append((None, None, None, "framing"))
                    continue
                rows.append((body if keep else None, len(body), hashlib.sha1(body).hexdigest(), None if said in (None, _digest(body)) else "digest"))
            yield pd.DataFrame(rows, columns=["payload", "bytes", "digest", "problem"]).astype({"bytes": "Int64"})

    out = records.withColumn("p", opened("block", "kind", "declared")).select(
        "origin", "kind", "page", "refers", "target", F.col("p.bytes").alias("payload_bytes"), F.col("p.digest").alias("payload_digest"),
        F.coalesce("problem", "p.problem").alias("problem"), *([F.col("p.payload").alias("payload")] if keep else []))
    return out


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages``, read the archives back, and return what they hold, a row for each page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, problem): a revisit's payload is
    the one of the page it refers to, found by its record; its digest must be the declared one.
    """
    spark = pages.sparkSession
    folder = working_folder(spark, "warc")
    write_pages(pages, folder, **options)
    read = stage(payloads(reassemble(read_records(spark, folder)), keep=False), "warc-read")
    wanted = read.where("kind = 'revisit'").select("target").distinct()
    stored = read.where("kind = 'response'").select(
        F.col("origin").alias("target"), F.col("payload_digest").alias("stored_digest"), F.col("payload_bytes").alias("stored_bytes"))
    full = read.join(stored.join(wanted, "target", "left_semi"), "target", "left")
    lost = F.when((F.col("kind") == "revisit") & ~F.col("payload_digest").eqNullSafe(F.col("stored_digest")), "target")
    return full.select(
        F.col("page").alias("page_id"), F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest",
        F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"), F.coalesce("problem", lost).alias("problem"))
