"""WARC archives: written one gzip member a record, and read back by byte ranges.

A reading task scans its range for the gzip magic number, decodes the start of each candidate and
takes it for a member only if a WARC header comes out; it owns the records that start inside its
range and reads the last of them beyond the end. So archives of any size split anywhere.

Nothing is lost silently. A member whose header came out must decode to its end. Members follow each
other without a gap: a file's first one starts at 0, each next one where the one before ends, and at
the end of a range the one after must have a header, or the file must end as its manifest says.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.storage import materialize, new_path

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 16
MANIFEST = "path string, bytes long, records long"
RECORD = ("path string, offset long, record_type string, page string, url string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(map(chr, range(33, 127)))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page, url, payload: bytes, refers_to=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit has the response's HTTP head and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
            ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    head += [("WARC-Target-URI", quote(url, safe=_SAFE))] if url is not None else []
    head += [("X-Page-ID", quote(str(page)))] if page is not None else []
    head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", quote(str(refers_to)))] if revisit else []
    data = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data.encode() + block + b"\r\n\r\n") + pack.flush()


def responses(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(page, url, html, refers_to): of equal payloads of ``least_bytes`` or more the one with the
    largest id is the response (with its repeats, if the id stands more than once) and the others
    refer to it. Null html is an empty payload. Without any id among them all are responses."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    keepers = rows.groupBy("digest").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    other = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper")) & (F.octet_length("html") >= least_bytes)
    return rows.join(keepers, "digest", "left").select("page", "url", "html", F.when(other, F.col("keeper")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Manifest of the archives written from (page, url, html, refers_to), one a task.

    A task attempt writes a file of its own name; only files in the manifest count, so what a lost
    or repeated attempt leaves behind is never read.
    """
    ship(rows.sparkSession)
    folder = qualified(rows.sparkSession, folder)

    def run(batches):
        store, base = _store(folder)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page, url, html.encode(), refers_to)
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": count}])

    return materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which for tasks is the one that Spark's tables have."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()


def _store(path: str):
    """File system and plain path of a URI or local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Window:
    """A file's bytes from ``start`` on, read as far as asked for."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    def upto(self, end: int) -> None:
        while self.start + len(self.data) < end:
            more = self.file.read(max(CHUNK, end - self.start - len(self.data)))
            if not more:
                break
            self.data += more

    def get(self, a: int, b: int) -> bytes:
        self.upto(b)
        return bytes(self.data[a - self.start:b - self.start])


def _header(data: bytes) -> dict[str, str] | None:
    head, found, _ = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return None
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Damaged(ValueError):
    """Bytes of an archive that are no record."""


def _member(window: _Window, at: int, head_only: bool = False) -> tuple[bytes, int] | None:
    """(bytes of the member, where it ends), or None if no record starts here; with ``head_only`` as
    far as its header goes. A record that starts here but does not decode is an error."""
    unpack, out, pos = zlib.decompressobj(31), bytearray(), at
    head = None
    while not unpack.eof:
        data = window.get(pos, pos + CHUNK)
        try:
            if not data:
                raise zlib.error("it is cut off")
            out += unpack.decompress(data)
        except zlib.error as problem:
            if head is None:
                return None
            raise Damaged(f"the record at {at} cannot be read: {problem}") from problem
        pos += len(data) - len(unpack.unused_data)
        if head is None:
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None
            head = _header(bytes(out))
        if head is not None and head_only:
            return bytes(out), pos
    return (bytes(out), pos) if head is not None else None


def records_of(file, start: int, end: int, size: int):
    """(offset, header, block) of the records of a file of ``size`` bytes that start in [start, end)."""
    if file.size() != size:
        raise Damaged(f"{file.size()} bytes instead of {size}")
    window = _Window(file, start)
    window.upto(end + len(MAGIC) - 1)
    at, due = start, 0 if start == 0 else None  # where the next record must start, if that is known
    while (place := window.data.find(MAGIC, at - start)) >= 0 and (at := start + place) < end:
        found = _member(window, at)
        if due is not None and (at != due or not found):
            break
        if not found:
            at += 1
            continue
        data, due = found
        head = _header(data)
        block = data[data.index(b"\r\n\r\n") + 4:][:int(head["content-length"])]
        yield at, head, block
        at = due
    if due is not None and due < size and (due < end or _member(window, due, head_only=True) is None):
        raise Damaged(f"no record at {due}")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``RECORD`` of every record in (path, bytes). Revisits have no payload, but the digest and size
    of the one they stand for. A payload that does not have its digest fails the job, as do a damaged,
    cut or missing file and bytes between records."""
    spark: SparkSession = manifest.sparkSession
    ship(spark)
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"), "bytes")
    n = max(1, ranges.count())

    def run(batches):
        for batch in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, plain = _store(path)
                with store.open_input_file(plain) as file:
                    rows = []
                    for offset, head, block in records_of(file, start, end, size):
                        rows.append(_row(path, offset, head, block))
                        if len(rows) >= 200:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page", pa.string()), ("url", pa.string()),
                        ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return ranges.repartition(n, "path", "start").select("path", "start", "end", "bytes").mapInArrow(run, RECORD)


def _row(path: str, offset: int, head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record at {offset} of {path} does not hold its payload")
    page, refers_to = (unquote(v) if (v := head.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id"))
    url = head.get("warc-target-uri")
    return {"path": path, "offset": offset, "record_type": head["warc-type"], "page": page, "url": unquote(url) if url is not None else None,
            "refers_to": refers_to, "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload}


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, split_bytes: int = SPLIT_BYTES,
                       id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and reads the archives back: ``RECORD`` with ``id_col`` for page and
    refers_to in its type. Null ids and urls stay null, repeated rows give a record each, an empty
    table gives no archive and no rows. ``folder`` is a place all executors reach."""
    folder = folder or new_path(pages.sparkSession, "warc")
    found = read_archives(write_archives(responses(pages, least_bytes, id_col, url_col, html_col), folder), split_bytes)
    kind = pages.schema[id_col].dataType
    return (found.withColumn("page", F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
            .withColumnRenamed("page", id_col))
