"""WARC archives: writing with revisit records and segmentation, reading with segment reassembly.

Of the pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is written whole and the others refer to it. A response's block
is an HTTP message in chunked transfer framing. A block longer than ``segment_bytes`` is cut: the first segment
is a response record with WARC-Segment-Number 1, the rest are continuation records with the first one's id as WARC-Segment-Origin-ID, the last
with WARC-Segment-Total-Length. Records end with two line ends, which is the line separator of the files that Spark writes, compressed with gzip, to
the folder in spark.checkpoint.dir.

The reader takes each archive, splits records by their Content-Length, and lets those that are whole through. Segments are grouped by
origin, which is unique to a record, put in order of their numbers and joined if numbers are complete and lengths add up to the total: first those of an archive, where it is read, so that
only segments of records that go on in another archive are kept and shuffled. Then chunked framing is decoded and the
payload's digest is compared with the record's. A record that fails in any of this is a row with ``error`` and what its head tells; after bytes that don't make a record, reading goes on at
the next one that begins. An origin that is whole in one archive is a record, and further segments of it in others are a row with ``error``.

An archive holds about ``ARCHIVE_BYTES`` at most, as a record is no longer than a segment, so that a task can hold it. Copies of one payload are found by digest: digests are counted before
the shuffle, and ids and digests of payloads with copies are joined to the pages, salted, so that no task gets all copies of one.

A revisit names its target's record in WARC-Refers-To; where rows repeat the target's id and payload, their records' IDs have a number besides, which it leaves out.

Edge cases: null html is an empty payload. A null page_id is read back as null and never is a response if a copy has an id. Rows with equal id and payload are
each a record, all responses if theirs is the smallest id. An empty table gives an empty result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES, SALTS = 4 << 10, 1500, 32 << 20, 16
#: About what a record has besides its block.
HEAD_BYTES = 600
NONE_ID = "none"
CONTENT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
RECORD = f"{CONTENT}, origin string, number int, total long, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts] + [b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing, chunk extensions and trailers included; raises ValueError if it is malformed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is shorter than its length")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, own_id: str, block: bytes, **fields: object) -> bytes:
    """Without the two line ends that follow."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{own_id}>", "WARC-Date": "2024-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None} | {"Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def page_urn(page: int | None, sha: str) -> str:
    return f"urn:page:{NONE_ID if page is None else page}:{sha}"


def page_records(page: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool, own_id: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    shown = NONE_ID if page is None else page
    uri = "".join(c for c in url or "" if c > " ") or f"urn:page:{shown}"
    common = {"WARC_Target_URI": uri, "X_Page_ID": shown, "WARC_Payload_Digest": f"sha1:{sha}", "Content_Type": "application/http;msgtype=response"}
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record("revisit", own_id, block, **common, WARC_Profile=profile, WARC_Refers_To=f"<{page_urn(refers_to, sha)}>")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(cut) == 1:
        return [record("response", own_id, block, **common)]
    out = [record("response", own_id, cut[0], **common, WARC_Segment_Number=1)]
    for n, part in enumerate(cut[1:], 2):
        total = len(block) if n == len(cut) else None
        out.append(record("continuation", f"{own_id}:{n}", part, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{own_id}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total))
    return out


def with_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with ``first``, the smallest id of those with its payload (null: it has no copies), ``repeated`` (some id stands twice with this payload) and ``revisit``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    known = pages if min_bytes <= 0 else pages.where(F.octet_length("html") >= min_bytes)
    of_page = known.groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    several = of_page.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("n").alias("most"), F.sum("n").alias("n")).where("n > 1").select("sha", "first", (F.col("most") > 1).alias("repeated"))
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = pages.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = own.join(salted, ["sha", "salt"], "left").drop("salt", "sha")
    enough = F.octet_length("html") >= min_bytes
    return joined.withColumn("revisit", F.col("first").isNotNull() & enough & ~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """A record for each row of pages, in files at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 100):
                out = []
                for page, url, html, first, repeated, revisit in zip(*(c.to_pylist() for c in b.slice(at, 100).columns), strict=True):
                    payload = html.encode()
                    sha = digest(payload)
                    unique = page is not None and not repeated and len(payload) >= min_bytes
                    own_id = page_urn(page, sha) + ("" if unique else f":{task}.{n}")
                    out += page_records(page, url, payload, sha, first if revisit else None, revisit, own_id, segment_bytes)
                    n += 1
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = with_copies(pages, min_bytes).mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (segment_bytes + HEAD_BYTES))).text(path)


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | str]]:
    """Head and block of each record; a text in place of the block says why there is none."""
    at = 0
    while at < len(data):
        head: dict[str, str] = {}
        try:
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no record begins here")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            stop = end + 4 + size
            if size < 0 or data[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("the block doesn't end where its length says")
            yield head, data[end + 4 : stop]
            at = stop + 4
        except (ValueError, KeyError) as why:
            yield head, f"byte {at}: {why}"
            after = data.find(b"\r\n\r\nWARC/", at + 1)
            at = len(data) if after < 0 else after + 4


def _page(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _content(head: dict[str, str], block: bytes) -> tuple:
    """The columns of CONTENT for a record that isn't segmented or is whole again."""
    page, sha = _page(head.get("x-page-id")), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = head.get("warc-type")
    try:
        if kind == "revisit":
            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:] if x)
            return page, int(fields["Content-Length"]), sha, "revisit", _page(head["warc-refers-to"].split(":")[2]), None
        payload = http_payload(block)
        if digest(payload) != sha:
            raise ValueError("the payload doesn't have its digest")
        return page, len(payload), sha, "response", None, None
    except (ValueError, KeyError, IndexError) as why:
        return page, None, sha, kind, None, f"{type(why).__name__}: {why}"


def joined_segments(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length or None, part) in any order; raises ValueError if it isn't whole."""
    segments = sorted(segments, key=lambda x: x[0])
    block = b"".join(x[2] for x in segments)
    totals = {x[1] for x in segments if x[1] is not None}
    if [x[0] for x in segments] != [*range(1, len(segments) + 1)] or totals != {len(block)}:
        raise ValueError(f"segments {[x[0] for x in segments]} with {len(block)} bytes of {totals}")
    return block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """CONTENT of each record in the archives at path, segmented ones reassembled."""
    import gzip

    schema = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]

    def row(head: dict[str, str], block: bytes | str) -> tuple:
        if isinstance(block, str):
            return (_page(head.get("x-page-id")), None, None, head.get("warc-type"), None, block, None, None, None, None)
        number, total = _page(head.get("warc-segment-number")), _page(head.get("warc-segment-total-length"))
        if number is None:
            return (*_content(head, block), None, None, None, None)
        if number == 1:
            sha = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
            return (_page(head.get("x-page-id")), None, sha, "response", None, None, head.get("warc-record-id", ""), 1, total, block)
        return (None, None, None, None, None, None, head.get("warc-segment-origin-id", ""), number, total, block)

    def reassembled(rows: list[tuple]) -> tuple:
        """Of the rows of one origin: page, digest, number, total, part; raises ValueError if they aren't whole."""
        block = joined_segments([x[2:] for x in rows])
        page, sha = min(rows, key=lambda x: x[2])[:2]
        return _content({"x-page-id": NONE_ID if page is None else str(page), "warc-payload-digest": sha or "", "warc-type": "response"}, block)

    def of_archive(rows: Iterator[tuple]) -> list[tuple]:
        """The rows of one archive, with one in place of segments that are all in it."""
        out, parts = [], {}
        for x in rows:
            if x[6] is None:
                out.append(x)
            else:
                parts.setdefault(x[6], []).append(x)
        for own in parts.values():
            try:
                out.append((*reassembled([(x[0], x[2], *x[7:]) for x in own]), None, None, None, None))
            except ValueError:
                out += own
        return out

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = of_archive(row(*x) for x in split_records(gzip.decompress(data.as_py())))
                for at in range(0, len(rows), 4000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4000], strict=True), schema, strict=True)], names=names)

    def ended(rows: list[tuple]) -> tuple:
        """As reassembled, of all there is of an origin, in order of their numbers."""
        try:
            return reassembled(rows)
        except ValueError as why:
            return rows[0][0], None, rows[0][1], "response", None, str(why)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []  # the origin whose rows still come
        for b in batches:
            out = []
            for origin, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own and origin != last:
                    out.append(ended(own))
                    own = []
                last = origin
                own.append(tuple(x))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema, strict=False)], names=names[:6])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(ended(own), schema, strict=False)], names=names[:6])

    files = spark.read.format("binaryFile").load(path).select("content")
    records = S.written(files.mapInArrow(parse, RECORD), "warc-records", "zstd")
    complete = records.where("origin IS NULL").select(*names[:6])
    segments = records.where("origin IS NOT NULL").select("origin", "page_id", "payload_digest", "number", "total", "block")
    in_order = segments.repartition("origin").sortWithinPartitions("origin", "number")
    return complete.unionByName(in_order.mapInArrow(whole, CONTENT))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.shared_path(spark, "warc")
    write_archives(S.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("error")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first, count(*) OVER (PARTITION BY sha) AS n FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to
FROM f
"""
