"""Operator 7, WARC: revisit resolution and deduplicated archives.

Archives are files of gzip members, a WARC 1.1 record each.  ``index`` reads their headers; ``resolve`` shuffles those by payload
digest, takes each digest's first response and joins the others to it as revisits; ``rewrite`` copies the archives with fresh
headers, a revisit without its payload; ``read`` gives the records back.  Only headers are shuffled: a payload is read from
its archive by the task that rewrites it.

A response of at least ``MIN_BYTES`` bytes is first if it has its digest's smallest page_id (null last, then the place in the
archives); shorter ones are all responses.  Revisit records that an archive already had join the response of their digest.

File names are unique to an attempt and known by the returned rows alone, so a retried task leaves no double.  A digest
that a third of the pages share is a row a task in the aggregation and a splittable key of the join.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<page_id>``; line ends in urls are percent-encoded; repeated
rows are records of their own, one the response and the others revisits of the same page_id; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdclens.llm import _store as S

MIN_BYTES = 100
#: Payload bytes after which an archive closes.
FILE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = pa.schema([("path", pa.string()), ("n_records", pa.int64())])


def record(kind: str, record_id: str, url: str, page_id: int | None, digest: str, size: int, payload: bytes | None, refers: dict[str, str] | None = None, date: str = DATE) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    head |= refers or {}
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(data: bytes, at: int = 0):
    """(offset, length, record bytes) of each member."""
    while at < len(data):
        d, parts, p = zlib.decompressobj(31), [], at
        while not d.eof:
            piece = data[p : p + (1 << 16)]
            if not piece:
                raise ValueError("a record breaks off")
            parts.append(d.decompress(piece))
            p += len(piece)
        end = p - len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(headers, declared payload bytes, payload) of a record."""
    cut = raw.index(b"\r\n\r\n")
    version, *lines = raw[:cut].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return head, size, payload


def _clean(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{page_id}" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


class _Writer:
    """Archives of one task."""

    def __init__(self, folder: str):
        self.fs, self.base = S.filesystem(folder)
        self.folder, self.out = folder, None

    def put(self, member: bytes) -> pa.RecordBatch | None:
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name, self.n, self.size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.out.write(member)
        self.n, self.size = self.n + 1, self.size + len(member)
        return self.close() if self.size >= FILE_BYTES else None

    def close(self) -> pa.RecordBatch | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return pa.RecordBatch.from_pydict({"path": [f"{self.folder}/{self.name}"], "n_records": [self.n]}, schema=_FILES)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """A response record for each row of (page_id, url, html); a row for each archive: path, n_records."""
    S.arrow_batches(pages.sparkSession)

    def of(batches):
        w = _Writer(folder)
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode()
                if done := w.put(record("response", f"urn:uuid:{uuid.uuid4()}", _clean(url, page_id), page_id, hashlib.sha256(payload).hexdigest(), len(payload), payload)):
                    yield done
        if done := w.close():
            yield done

    return S.table(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(of, "path string, n_records long"), "warc-files")


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_INDEX_SQL = "path string, offset long, length long, page_id long, url string, kind string, record_id string, refers_page long, payload_bytes long, payload_digest string"


def index(archives: DataFrame) -> DataFrame:
    """The headers of the archives' records, a response's digest and size checked against its payload."""
    S.arrow_batches(archives.sparkSession)

    def of(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = S.filesystem(path)
                with fs.open_input_file(p) as f:
                    data = f.read()
                rows = []
                for offset, length, raw in members(data):
                    head, size, payload = parse(raw)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{path} at {offset}: payload and header differ")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((path, offset, length, number("X-Page-Id"), head["WARC-Target-URI"], head["WARC-Type"], head["WARC-Record-ID"][1:-1], number("X-Refers-To-Page-Id"), size, digest))
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _INDEX)], schema=_INDEX)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _INDEX)], schema=_INDEX)

    spread = archives.select("path").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(of, _INDEX_SQL)


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The headers with ``first`` (page_id, url, record_id of the response that a revisit refers to, null for responses)."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset", "url", "record_id")
    first = (
        headers.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)).groupBy("payload_digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
    )
    known = headers.where(F.col("kind") != "response").select("payload_digest").distinct().withColumn("asked", F.lit(True))
    # digests of one response, which no revisit asks for, drop out before the join
    first = first.join(known, "payload_digest", "left").where((F.col("n") > 1) | F.col("asked")).select("payload_digest", "first")
    out = headers.join(first, "payload_digest", "left")
    own = F.col("first").isNotNull() & (F.col("first.path") == F.col("path")) & (F.col("first.offset") == F.col("offset"))
    return out.withColumn("first", F.when(~own, F.col("first"))).withColumn("first", F.struct(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), F.col("first.record_id").alias("record_id")))


def rewrite(resolved: DataFrame, folder: str) -> DataFrame:
    """Deduplicated archives; a row for each: path, n_records.  Record ids stay, so what refers to them still does."""
    S.arrow_batches(resolved.sparkSession)

    def of(batches):
        w, path, data = _Writer(folder), None, b""
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "offset", "length", "page_id", "url", "kind", "record_id", "refers_page", "payload_bytes", "payload_digest", "first")]
            for p, offset, length, page_id, url, kind, record_id, refers_page, size, digest, first in zip(*columns):
                revisit = first["record_id"] is not None or kind != "response"
                payload, refers = None, None
                if revisit:
                    refers = {"WARC-Profile": PROFILE}
                    if first["record_id"] is not None:
                        refers |= {"WARC-Refers-To": f"<{first['record_id']}>", "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": DATE}
                    refers_page = first["page_id"] if first["record_id"] is not None else refers_page
                    if refers_page is not None:
                        refers["X-Refers-To-Page-Id"] = str(refers_page)
                else:
                    if p != path:
                        fs, at = S.filesystem(p)
                        with fs.open_input_file(at) as f:
                            path, data = p, f.read()
                    payload = parse(next(members(data[offset : offset + length]))[2])[2]
                if done := w.put(record("revisit" if revisit else "response", record_id, url, page_id, digest, size, payload, refers)):
                    yield done
        if done := w.close():
            yield done

    by_file = resolved.repartition(int(resolved.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "offset")
    return S.table(by_file.mapInArrow(of, "path string, n_records long"), "warc-files")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the deduplicated archives."""
    raw = write(S.read_table(spark, sf_dir, "pages"), S.shared(spark, "warc"))
    done = rewrite(resolve(S.table(index(raw), "warc-index")), S.shared(spark, "warc"))
    return index(done).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  row_number() OVER (PARTITION BY html ORDER BY page_id) AS nth, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 OR payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 AND payload_bytes >= 100 THEN first END AS refers_to FROM q
"""
