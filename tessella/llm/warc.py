"""WARC archives: a writer with revisit records and a splittable reader.

Writer: a record per row, each its own gzip member, in files of bounded size under a shared
folder.  A task writes under a name of its own attempt, and only the names that successful
tasks return are used, so lost executors and repeated tasks leave no half-read files.

Reader: files are cut into byte ranges.  A task looks for gzip magic from the start of its
range, takes a candidate only if it decodes to a complete WARC header, and owns every record
whose member starts inside the range; the last one may end outside.  From a valid member the
next one starts where it ends; after damage the search for magic goes on.

Files are reached through ``pyarrow.fs``, so any store with a URI works.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, small

FILE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
MIN_REVISIT_BYTES = 1000
MAX_BROADCAST_ROWS = 200_000
#: Most tasks of a read; beyond, a task has several ranges.
MAX_READ_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 18


def _clean(value: str) -> str:
    """A header value: control characters and non-ASCII bytes percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _urn(page_id: int | None) -> str:
    """A record's name; rows without an id share one."""
    return "<urn:x-page:none>" if page_id is None else f"<urn:x-page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """The bytes of one record; a revisit has the HTTP head of its response but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, html, digest, record_type, refers_to); returns (path, bytes, records).

    The result must be written before it is read twice: each evaluation writes new files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        done: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, digest, kind, refers = (c[k].as_py() for c in cols)
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = files.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, kind, refers)) + z.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{root}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{root}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return rows.mapInArrow(run, "path string, bytes bigint, records bigint")


class _Source:
    """A file read forwards from a position, with a buffer that starts at ``at``."""

    def __init__(self, handle, at: int, size: int):
        self.handle, self.at, self.size, self.buf = handle, at, size, b""

    def more(self) -> bool:
        pos = self.at + len(self.buf)
        if pos >= self.size:
            return False
        self.handle.seek(pos)
        self.buf += self.handle.read(min(_READ, self.size - pos))
        return True

    def skip(self, n: int) -> None:
        self.buf, self.at = self.buf[n:], self.at + n


def _member(src: _Source) -> bytes | None:
    """The decoded gzip member at the buffer's start, which is then passed; None if there is none."""
    start, z, out, used, checked = src.at, zlib.decompressobj(31), [], 0, False
    head = b""
    keep = src.buf
    try:
        while True:
            if used == len(src.buf):
                if not src.more():
                    break
            piece = src.buf[used:]
            got = z.decompress(piece)
            used = len(src.buf)
            out.append(got)
            if not checked:
                head += got
                if not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1."):
                    break
                checked = b"\r\n\r\n" in head
            if z.eof:
                used -= len(z.unused_data)
                data = b"".join(out)
                if parse(data) is None:
                    break
                src.skip(used)
                return data
    except zlib.error:
        pass
    src.at, src.buf = start, src.buf if len(src.buf) >= len(keep) else keep
    return None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and block of a complete record, else None."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    return (fields, rest[:n]) if len(rest) >= n else None


def records_in(handle, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in [start, end)."""
    src = _Source(handle, start, size)
    while src.at < end:
        if len(src.buf) < len(MAGIC) and not src.more() and len(src.buf) < len(MAGIC):
            return
        if src.buf.startswith(MAGIC) and (data := _member(src)) is not None:
            yield parse(data)
            continue
        k = src.buf.find(MAGIC, 1)
        src.skip(k if k > 0 else max(1, len(src.buf) - len(MAGIC) + 1))


def _page(urn: str | None) -> int | None:
    name = urn.strip("<>").rpartition(":")[2] if urn else "none"
    return None if name == "none" else int(name)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of all records.

    A response's digest is computed anew and must equal its header's.  html is null for
    revisits.  Ranges are dealt over a count of tasks that is fixed from their number, which
    adaptive execution does not merge, however few bytes the table of ranges has.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    ranges = files.where("bytes > 0").select("path", "bytes", starts).withColumn("end", F.least(F.col("start") + split_bytes, "bytes"))
    number = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(number), MAX_READ_TASKS))
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            for r in batch.to_pylist():
                files_, path = _filesystem(r["path"])
                rows, held = [], 0
                with files_.open_input_file(path) as handle:
                    for fields, block in records_in(handle, r["bytes"], r["start"], r["end"]):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
                        size = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record {fields['warc-record-id']} in {r['path']}")
                        html = payload.decode("utf-8") if kind == "response" else None
                        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to")), html))
                        held += len(payload)
                        if held > (4 << 20):
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.select("path", "bytes", "start", "end").mapInArrow(run, schema)


def plan_records(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with digest, record_type and refers_to.

    Of equal payloads of at least ``least`` bytes the row with the largest page_id is the
    response and the others revisit it; rows repeated with that page_id are all responses.
    Null html is an empty payload.  A null page_id never wins over another.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    keyed = rows.select("page_id", F.sha2(raw, 256).alias("key"), F.octet_length(raw).alias("n")).where(F.col("n") >= least)
    groups = keyed.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("key", "first")
    ws = Workspace(pages.sparkSession, "warc_groups")
    groups = ws.write(groups, "groups")
    if small(groups, MAX_BROADCAST_ROWS):
        groups = F.broadcast(groups)
    made = rows.withColumn("key", F.sha2(raw, 256)).withColumn("digest", F.sha1(raw)).join(groups, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return made.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to archives and reads them back; the archives live in the shared folder.

    A row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.  Null html is
    an empty payload, a null url is left out of the record, a null page_id is read back as null.
    Rows repeated come back as often as they went in; an empty table gives no rows and no
    archive; extra columns are ignored.
    """
    ws = Workspace(spark, "warc")
    files = ws.write(write_archives(plan_records(pages), ws.path("archives")), "files")
    read = ws.write(read_archives(files).drop("html", "url"), "records")
    ws.drop("archives", "files")
    return read
