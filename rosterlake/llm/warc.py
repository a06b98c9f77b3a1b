"""WARC archives of pages with an index of byte ranges, and reads of selected records by coalesced ranges of that index."""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import join_sized, small_batches, spill, table
from rosterlake.session import ensure_checkpoint_dir

MIN_SHARED = 1000  # bytes from which equal payloads are stored once
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(path: str):
    """The store of a path and the path in it; ``file:/x`` is written with three slashes for it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def pack_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response record, or a revisit record with the HTTP head alone where ``refers_to`` names the stored page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
            f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def unpack_record(member: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Named fields, payload (None in a revisit record) and the length that the HTTP head states."""
    head, rest = zlib.decompress(member, 31).split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields, (payload if fields["WARC-Type"] == "response" else None), stated


def _writer(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches):
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        for b in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a repeated attempt writes files of its own; the index names those that count
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = pack_record(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(member)
                rows.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, f"{folder}/{name}", at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, schema)], schema=schema)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per page and return the index: page_id, url, digest, record_type, refers_to, file, offset, length.

    Of pages with equal payloads of ``MIN_SHARED`` bytes or more, the largest page_id is stored and the others refer to it (rows
    that repeat that page_id are stored each; a NULL page_id is never the largest; a group of NULL ids alone is stored each). A NULL
    html is an empty payload. The index is stored in the shared folder; it names the files of the attempts that finished.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    shared = keyed.where(F.octet_length("html") >= MIN_SHARED).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL")
    told = join_sized(keyed, spill(shared.select("digest", "holder")), ["digest"], "left")
    told = told.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))
    return spill(told.mapInArrow(_writer(folder), INDEX))


def _reader(with_payload: bool):
    names = [f.name for f in T.StructType.fromDDL(RECORD).fields]

    def read(batches):
        for b in batches:
            for file, records in zip(b.column("file").to_pylist(), b.column("records").to_pylist()):
                records.sort(key=lambda r: r["offset"])
                start, stop = records[0]["offset"], max(r["offset"] + r["length"] for r in records)
                store, path = _filesystem(file)
                with store.open_input_file(path) as f:
                    data = f.read_at(stop - start, start)
                out, payloads = [], []
                for r in records:
                    fields, payload, stated = unpack_record(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    page, other = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != stated):
                        raise ValueError(f"damaged record at {r['offset']} of {file}")
                    out.append((int(page) if page else None, stated, digest, fields["WARC-Type"], int(other) if other else None))
                    payloads.append(payload)
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
                if with_payload:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(payloads, pa.binary())], names=[*names, "payload"])
                else:
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return read


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name, read back: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Rows of a file in the order of their offsets become one read as long as the gap to the next is at most ``GAP_BYTES`` and the read
    stays within ``READ_BYTES``. A payload that does not match its digest is an error. Repeated index rows are read as often.
    """
    order = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length"), 1, 0).over(order)
    island = F.sum((gap > GAP_BYTES).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranges = index.select("file", "offset", "length", island.alias("island"), F.floor(F.col("offset") / READ_BYTES).alias("part"))
    ranges = ranges.groupBy("file", "island", "part").agg(F.collect_list(F.struct("offset", "length")).alias("records"))
    return ranges.mapInArrow(_reader(with_payload), RECORD + (", payload binary" if with_payload else ""))


def archive_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def op7_indexed_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(table(spark, sf_dir, "pages"), archive_folder(spark)))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT *, CASE WHEN n >= {MIN_SHARED} THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM h
"""
