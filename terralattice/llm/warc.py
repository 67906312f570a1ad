"""WARC archives: a writer that revisits repeated payloads, and a splittable reader.

Writing.  Every record is a gzip member of its own.  Payloads are compared by their SHA-1.  Of
equal payloads of at least ``min_bytes``, the row with the largest page id is the response and the others are revisits that
name it and keep the HTTP header with the payload's length; smaller payloads are all responses.  Spark's own
text writer puts the members into part files of any file system it knows, with its commit protocol: a row is a member
without its last byte, and that byte, zero for any member under 16 MB, is the line separator (a larger member is
followed by an empty member, whose last byte is zero).

Reading.  Files are cut into byte ranges.  A task looks for the gzip magic from its range's start, decodes the head of each
candidate and takes it for a record only if a WARC header comes out; it then goes from member to
member, owning those that start inside its range and reading the last one past its end.

Nulls: a null html is an empty payload, a null url an empty target.  A null page id is written as such; it is the response only if
no equal payload has an id, and rows that repeat the chosen id are all responses.  Very long pages are one member each, held whole.  An
empty table gives an archive without records, and such an archive no rows.  Extra columns of pages, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralattice.llm._common import Stored, column, prepare, scratch_path

RANGE_BYTES = 32 << 20
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 1 << 10
_STEP = 1 << 20
_SCHEMA = (
    "record_type string, page_id long, refers_to long, target string, payload_digest string, payload_length long, payload binary"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_bytes(page_id, url: str | None, payload: bytes, length: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One uncompressed record.  ``length`` is the full payload's, also where the record leaves it out."""
    block = _HTTP % length + (b"" if revisit else payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _members(date: str):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(6)))
            out = []
            for page_id, url, payload, digest, chosen, alone in rows:
                payload = payload or b""
                revisit = not alone and page_id != chosen
                data = record_bytes(page_id, url, payload, len(payload), base32_digest(digest), chosen, revisit, date)
                member = gzip_member(data)
                if member[-1]:
                    member += gzip_member(b"")
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    min_bytes: int = 0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a record per row of ``pages`` under ``path``."""
    prepare(pages.sparkSession)
    rows = pages.select(
        column(page_id).cast("long").alias("page_id"),
        column(url).alias("url"),
        F.encode(F.coalesce(column(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Counted per digest from narrow rows, and stored, so that the join can split a digest that many pages share.
    chosen = Stored(rows.groupBy("digest").agg(F.max("page_id").alias("chosen")), "digests")
    members = (
        # A digest has one row there; hashing it spares sorting the payloads.
        rows.join(chosen.df.hint("shuffle_hash"), "digest")
        .select(
            "page_id",
            "url",
            "payload",
            "digest",
            "chosen",
            (F.octet_length("payload") < min_bytes).alias("alone"),
        )
        .mapInArrow(_members(date), "member binary")
    )
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
    chosen.drop()


def archive_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """file, first, end of every byte range; files are listed through Spark's file system layer."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in system.listStatus(at):
        size, name = status.getLen(), status.getPath().getName()
        if status.isFile() and not name.startswith(("_", ".")):
            rows += [(status.getPath().toString(), a, min(size, a + range_bytes)) for a in range(0, size, range_bytes)]
    frame = spark.createDataFrame(rows, "file string, first long, end long")
    return frame.repartition(max(1, len(rows))) if rows else frame


class _Window:
    """A growing view of a file from an offset on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_STEP)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        """Forgets what lies before the offset ``to``."""
        self.data, self.at = self.data[to - self.at :], to


def _decoded(window: _Window) -> tuple[bytes, int] | None:
    """The member at the window's start and its length; None if it doesn't decode to its end."""
    unpack, parts, used = zlib.decompressobj(31), [], 0
    try:
        while True:
            parts.append(unpack.decompress(window.data[used:]))
            used = len(window.data) - len(unpack.unused_data)
            if unpack.eof:
                return b"".join(parts), used
            if not window.more():
                return None
    except zlib.error:
        return None


def _is_record(window: _Window) -> bool:
    """Whether a WARC header comes out of the candidate at the window's start."""
    while len(window.data) < _HEAD and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.data[:_HEAD], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def records_in_range(file, first: int, end: int):
    """The records that start in [first, end) of an open file, decoded."""
    window = _Window(file, first)
    while window.at < end:
        found = window.data.find(_MAGIC)
        if found < 0:
            # Two bytes may begin a magic that goes on in the next read.
            window.drop(window.at + max(0, len(window.data) - 2))
            if not window.more():
                return
            continue
        window.drop(window.at + found)
        if window.at >= end:
            return
        if not _is_record(window) or (member := _decoded(window)) is None:
            window.drop(window.at + 1)
            continue
        window.drop(window.at + member[1])
        yield member[0]


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(
        (k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    )
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(
        (int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), len(payload)
    )

    def number(name: str):
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value and value != "null" else None

    revisit = fields["warc-type"] == "revisit"
    return {
        "record_type": fields["warc-type"],
        "page_id": number("warc-record-id"),
        "refers_to": number("warc-refers-to") if revisit else None,
        "target": fields.get("warc-target-uri", ""),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_length": length if revisit else len(payload),
        "payload": None if revisit else payload,
    }


_ARROW = pa.schema(
    [
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("target", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_length", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_archives(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record under ``path``: type, ids, target, digest, length and payload."""
    prepare(spark)

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for file, first, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                uri = file if "://" in file else file.replace("file:/", "file:///", 1)
                system, name = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with system.open_input_file(name) as opened:
                    for data in records_in_range(opened, first, end):
                        rows.append(parse_record(data))
                        size += len(data)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return archive_ranges(spark, path, range_bytes).mapInArrow(run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), bits AS (
  SELECT DISTINCT d, list_reduce(list_transform(generate_series(1, 40),
    lambda i: lpad(to_binary(CAST('0x' || d[i] AS INTEGER)), 4, '0')), lambda a, b: a || b) AS b FROM p
), code AS (
  SELECT d, list_reduce(list_transform(generate_series(0, 31),
    lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(generate_series(1, 5),
      lambda k: CAST(b[5 * i + k] AS INTEGER) * (CAST(1 AS INTEGER) << CAST(5 - k AS INTEGER)))) AS INTEGER)]), lambda a, c: a || c) AS digest
  FROM bits
), top AS (SELECT d, max(page_id) AS m FROM p GROUP BY d)
SELECT p.page_id AS page_id, strlen(p.h) AS payload_bytes, code.digest AS payload_digest,
       CASE WHEN p.page_id = top.m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = top.m THEN NULL ELSE top.m END AS refers_to
FROM p JOIN top USING (d) JOIN code USING (d)
"""
