"""WARC archives written by tasks, an index of every record, and coalesced byte-range reads."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, new_path, partitions, stored, table, texts_of

#: Payloads shorter than this are always stored in full.
LEAST = 100
#: A read joins records that lie at most GAP bytes apart and is at most SPAN bytes, but for one larger record.
GAP, SPAN = 64 << 10, 8 << 20
#: A task reads the records of so many bytes of one file.
SLICE = 16 << 20
_DATE = "2000-01-01T00:00:00Z"
_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def open_folder(uri: str):
    """A file system and a path on it, for any scheme pyarrow reads (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 resource or revisit record as a gzip member of its own."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit")]
    head += [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        head.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError where the block doesn't match its digest or length."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    said = dict(x.split(": ", 1) for x in lines[1:])
    n = int(said["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it states")
    if said["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(rest[:n]).hexdigest() != said["WARC-Payload-Digest"]:
        raise ValueError("a payload of another digest than it states")
    return said, rest[:n]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in folder; returns the index, one row a record.

    Payloads of LEAST bytes or more that occur more than once are found by their digests alone (minimum
    page_id per digest, combined before the shuffle); the page with the smallest page_id holds the payload,
    the others become revisit records. Each task writes one archive under a name of its own and the index
    names only archives of tasks that ended, so a task that is run again leaves no double records.

    Null html counts as empty, a null url as no target. Rows with a null page_id are stored as responses
    under the id None and never referred to. Of rows with equal page_id and payload, all are alike: the
    smallest id's rows are responses.
    """
    payload = F.coalesce("html", F.lit(""))
    bounded(pages)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("text"))
    pages = pages.withColumn("digest", F.sha2("text", 256))
    many = pages.where(F.octet_length("text") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # payloads travel by page, not by digest: one page that many hosts serve is no hot key
    revisits = pages.where(F.octet_length("text") >= LEAST).select("page_id", "digest").join(many, "digest").where("first < page_id").distinct()
    pages = pages.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "text", "digest", F.col("first").alias("refers_to"))

    def run(batches):
        fs, at = open_folder(folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
        first = next(batches, None)
        if first is None:
            return
        offset = 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in itertools.chain([first], batches):
                ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
                rows = []
                for page_id, url, text, digest, to in zip(ids, urls, texts_of(batch), digests, refers, strict=True):
                    out.write(member := record(page_id, url, text, digest, to))
                    rows.append((name, offset, len(member), url, digest, page_id, "response" if to is None else "revisit"))
                    offset += len(member)
                cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return stored(pages.mapInArrow(run, _INDEX), "index")


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads the records of index (a selection of what write() returned) back from folder.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).
    Records are dealt out by file and slice, sorted by offset, and read in joined ranges: the archive is not
    read where nothing was selected. A damaged record raises an error; it is never skipped.
    """
    bounded(index)
    spans = index.select("file", "offset", "length").withColumn("slice", F.floor(F.col("offset") / SLICE))
    # a number of tasks by bytes of archive, which index rows are too small to show
    tasks = max(partitions(index.sparkSession), -(-(index.agg(F.sum("length")).first()[0] or 0) // SLICE))
    spans = spans.repartition(tasks, "file", "slice").sortWithinPartitions("file", "offset")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def number(urn: str | None):
        n = urn[10:-1] if urn else "None"
        return None if n == "None" else int(n)

    def run(batches):
        fs, at = open_folder(folder)
        opened: list = [None, None]

        def fetch(span):
            file, start, end, parts = span
            if opened[0] != file:
                opened[:] = [file, fs.open_input_file(f"{at}/{file}")]
            data = opened[1].read_at(end - start, start)
            rows = []
            for offset, length in parts:
                head, block = parsed(data[offset - start : offset - start + length])
                kind = head["WARC-Type"]
                rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), kind, number(head.get("WARC-Refers-To")), block if kind == "response" else None))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)], schema=schema)

        span = None
        for batch in batches:
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if span and span[0] == file and 0 <= offset - span[2] <= GAP and offset + length - span[1] <= SPAN:
                    span[2] = offset + length
                    span[3].append((offset, length))
                    continue
                if span:
                    yield fetch(span)
                span = [file, offset, offset + length, [(offset, length)]]
        if span:
            yield fetch(span)

    return spans.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
