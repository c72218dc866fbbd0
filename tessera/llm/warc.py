"""WARC archives: write records and an index of them first, then read selected records by coalesced byte ranges.

Writing: each task writes one archive (per-record gzip members, so any record can be read alone) into the shared folder, under a
name of its own attempt, and returns an index row per record: file, offset, length, URL, digest, id. The index is a table in the
shared folder; an attempt that died leaves an archive that no index row names. Reading: index rows are dealt by archive
and block of it, sorted by offset, ranges less than `GAP` bytes apart are read in one request, and each record is parsed back from
its own bytes.

Equal payloads (those of equal SHA-1): the record with the smallest id is a `response`, the others are `revisit` records without a
payload which name it; payloads under `least` bytes are always written. Null html is an empty payload, a null URL an empty
target. A null id sorts before all others and is written as an empty id. Repeated rows: all rows with the smallest id of a payload
are responses. Columns other than id, URL and payload are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

GAP = 1 << 16
#: Bytes read at once at most, unless one record is longer.
STRETCH = 8 << 20
INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, payload_digest string, record_type string"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, sha: str, is_revisit: bool) -> bytes:
    """One record as a gzip member. The length of a revisit's full payload is kept in an extension field."""
    block = b"" if is_revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url.encode('unicode_escape').decode()}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Full-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    raw = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return {"fields": fields, "block": rest[: int(fields["Content-Length"])]}


def with_types(pages: DataFrame, scratch: Scratch, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to (null for a response): digests are pre-aggregated, and only those that occur twice are joined."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("d", F.sha1("payload"))
    # A null id is the smallest; -2**63 stands for it while ids are compared.
    low = F.coalesce(F.col("page_id"), F.lit(-(2**63)))
    again = rows.where(F.octet_length("payload") >= least).groupBy("d").agg(F.min(low).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first_id")
    again = scratch.table(again, "again")  # a scan on either side, so that a hot digest can be split by the join
    typed = rows.join(again, "d", "left").withColumn("is_revisit", F.col("first_id").isNotNull() & (low != F.col("first_id")))
    return typed.select("page_id", "url", "payload", F.when(F.col("is_revisit"), F.nullif("first_id", F.lit(-(2**63)))).alias("refers_to"), "is_revisit")


def write(pages: DataFrame, scratch: Scratch, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives in the shared folder; returns the index table, one row per record."""
    root = f"{scratch.root}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for batch in batches:
                rows: dict[str, list] = {k: [] for k in ("page_id", "file", "offset", "length", "url", "payload_digest", "record_type")}
                for page_id, url, payload, refers_to, again in zip(*(c.to_pylist() for c in batch.columns)):
                    sha = digest(payload)
                    member = record(page_id, url, payload, refers_to, sha, again)
                    if out is None:
                        out = store.open_output_stream(name, compression=None)  # the members are compressed already
                    out.write(member)
                    for k, v in zip(rows, (page_id, name.rpartition("/")[2], at, len(member), url, sha, "revisit" if again else "response")):
                        rows[k].append(v)
                    at += len(member)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))
        finally:
            if out is not None:
                out.close()

    return scratch.table(with_types(pages, scratch, least, id_col, url_col, html_col).mapInArrow(run, INDEX), "index")


def read(index: DataFrame, root: str, stretch: int = STRETCH, gap: int = GAP, with_payload: bool = True) -> DataFrame:
    """The records that `index` selects, read from the archives under `root`/archives by coalesced, sorted ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(f"{root}/archives")
        for batch in batches:
            wanted = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            k = 0
            while k < len(wanted):
                file, begin, length = wanted[k]
                end, j = begin + length, k + 1
                while j < len(wanted) and wanted[j][0] == file and wanted[j][1] - end <= gap and wanted[j][1] + wanted[j][2] - begin <= stretch:
                    end = max(end, wanted[j][1] + wanted[j][2])
                    j += 1
                with store.open_input_file(f"{base}/{file}") as f:
                    f.seek(begin)
                    data = f.read(end - begin)
                rows: dict[str, list] = {x: [] for x in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")}
                for _, at, n in wanted[k:j]:
                    got = parse(data[at - begin : at - begin + n])
                    h, block = got["fields"], got["block"]
                    again = h["WARC-Type"] == "revisit"
                    sha = h["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest(block)
                    if not again and h["WARC-Payload-Digest"] != f"sha1:{sha}":
                        raise ValueError(f"damaged record in {file} at {at}")
                    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
                    for x, v in zip(rows, (number(h["WARC-Record-ID"]), int(h["X-Full-Payload-Length"]) if again else len(block), sha, h["WARC-Type"], number(h["WARC-Refers-To"]) if again else None, h["WARC-Target-URI"].encode().decode("unicode_escape"), block if with_payload and not again else None)):
                        rows[x].append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))
                k = j

    ranges = index.select("file", "offset", "length")
    # Neighbouring records go to one task; an archive of any length is spread over many.
    ranges = ranges.withColumn("_part", F.floor(F.col("offset") / stretch)).repartition("file", "_part").sortWithinPartitions("file", "offset").drop("_part")
    return ranges.mapInArrow(run, READ)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, then read every record back."""
    scratch = Scratch(spark, "warc")
    return read(write(pages, scratch, least), scratch.root, with_payload=False)


ORACLE = """
with p as (select page_id, sha1(coalesce(html, '')) h, strlen(coalesce(html, ''))::bigint payload_bytes from pages),
f as (select h, min(page_id) first_id from p group by h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (k // 4))::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int, 1)), '') payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id = first_id then null else first_id end refers_to
from p join f using (h)
"""
