"""Web archives: writing, reading back, and revisit records for payloads stored before."""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.runtime import scratch_folder

# Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = "\r\n"
RECORD_END = LINE * 2

CAPTURED = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 50_000

_READ = ("record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, "
         "refers_to string, refers_to_page long, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary: five hex digits make four base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page: Column) -> Column:
    """A record's URN from its page number; a page without one is named by nothing else."""
    d = F.md5(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("-"))).cast("binary"))
    parts = [F.substring(d, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of pages; null html is an empty payload."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"),
                        F.octet_length(body).cast("long").alias("payload_bytes"),
                        base32_sha1(body.cast("binary")).alias("payload_digest"))


def resolve_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``original``: the page whose response a record repeats, null for responses.

    Headers alone are shuffled by payload digest and reduced to the smallest page
    per digest (partial minima, so a payload that most pages share is no hot group);
    the records are then joined with these originals. Payloads below
    ``least_bytes`` are always responses, and so is every row of the smallest page
    (a row that repeats page and payload repeats the response). A record without
    page number revisits if another one of its payload has a number.
    """
    first = (records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
             .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull()))
    joined = records.join(first.drop("_n"), "payload_digest", "left")
    repeats = (F.col("payload_bytes") >= least_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("original", F.when(repeats, F.col("_first"))).drop("_first")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line breaks in a value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(LINE)), F.lit(""))


def as_records(resolved: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """One text per record: fresh headers, and the payload for responses only.

    A revisit keeps the HTTP header of the capture, so the length of what it stands
    for stays known.
    """
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(VERSION + LINE), _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", record_id(F.col("page_id"))), _field("WARC-Date", F.lit(captured)),
        _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))), _field("WARC-Refers-To", F.when(revisit, record_id(F.col("original")))),
        _field("WARC-Refers-To-Date", F.when(revisit, F.lit(captured))),
        _field("X-Page-Id", F.col("page_id")), _field("X-Refers-To-Page-Id", F.col("original")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", length), F.lit(LINE))
    return resolved.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(resolved: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes records into compressed archive files of a shared folder, one or more per task.

    Spark's text writer ends every record as the format asks and commits files
    only when a task has succeeded, so a lost executor leaves no half record.
    """
    (as_records(resolved).write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(folder))


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of every record, by the stated lengths."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = bytes(view[at:end]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        yield head, view[end + 4: stop]
        if archive[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end as its length says")
        at = stop + 4


def _row(head: dict[str, str], block: memoryview, payload: bool) -> tuple:
    raw = bytes(block)
    cut = raw.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in raw[:cut].decode("latin-1").split("\r\n")[1:] if ": " in x)
    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["Content-Length"])
    if head["warc-type"] == "response":
        found = b32encode(hashlib.sha1(raw[cut:]).digest()).decode()
        if (found, len(raw) - cut) != (digest, size):
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    page, other = (int(head[x]) if x in head else None for x in ("x-page-id", "x-refers-to-page-id"))
    return (head["warc-record-id"], head["warc-type"], page, head.get("warc-target-uri"), size, digest,
            head.get("warc-refers-to"), other, raw[cut:] if payload and head["warc-type"] == "response" else None)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of all archive files in a folder; digests of responses are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                            ("refers_to_page", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                data = content.as_py()
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(_row(head, block, payload))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(read, _READ)


def deduplicated_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Writes pages as an archive without repeated payloads; returns its folder and what was read back."""
    folder = folder or scratch_folder(pages.sparkSession, "archives")
    write_archives(resolve_revisits(captures(pages), least_bytes), folder)
    return folder, read_archives(pages.sparkSession, folder)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page, from the archives read back: length and digest of its payload, and what it revisits."""
    folder = scratch_folder(pages.sparkSession, "archives")
    write_archives(resolve_revisits(captures(pages), least_bytes), folder)
    back = read_archives(pages.sparkSession, folder, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "url")
