"""WARC archives as a chunked record table.

Writing: payloads are cut into segments of at most ``segment_bytes``; each is a WARC record of its own (a first record
and ``continuation`` records with WARC-Segment-Number), carries the digest of its block and the running digest of the
payload so far, and is one row of a text table whose line separator is the blank line that WARC puts between records.
``records_per_file`` rows go to a file, so an archive has a bounded size. Reading: archives are parsed by
Content-Length into rows (record_id, chunk_no, block). Records of one chunk are digested where they are read; only the
chunks of longer ones are shuffled, meet sorted, and one pass carries their SHA-1 from chunk to chunk, so neither side
ever holds a set of records, nor the reader a long one.

Payload copies: of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the
response; others are written as revisits without payload. The largest id comes from one aggregate by digest. A record
id is made of page_id and digest, so a revisit can name the response without knowing where it lies.

Defined results: null html is the empty payload; a null url is left out; a null page_id counts as the smallest; rows
repeated with the response's own page_id are responses too, with the place of writing in their ids, and their revisits
name the page and digest only; other columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, scratch_path, small, table

SEGMENT_BYTES = 64 * 1024
RECORDS_PER_FILE = 256
GAP = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no int, page_id long, url string, record_type string, refers_to long, said_digest string, said_bytes long, running_digest string, block binary"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def segments(payload: bytes, most: int):
    """Slices of at most ``most`` bytes that end between characters; one empty slice for an empty payload."""
    view, at = memoryview(payload), 0
    while True:
        end = min(at + most, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield view[at:end]
        at = end
        if at >= len(payload):
            return


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    head = "\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None]])
    return f"{head}\r\nContent-Length: {len(block)}{GAP}{bytes(block).decode()}"


def _written(segment_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        safe = lambda u: u and "".join(c if c > " " else f"%{ord(c):02X}" for c in u)

        def rows():
            nonlocal n
            for b in batches:
                for page_id, url, html, size, sha, refers, alone in zip(*(b.column(i) for i in range(7))):
                    page_id, refers, url, alone = page_id.as_py(), refers.as_py(), safe(url.as_py()), alone.as_py()
                    record, n = f"<urn:page:{page_id}:{sha.as_py()}>" if alone and refers is None else f"<urn:page:{page_id}:{sha.as_py()}:{part}-{n}>", n + 1
                    shared = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id)]
                    digest = "sha1:" + base32_sha1(bytes.fromhex(sha.as_py()))
                    if refers is not None:
                        v = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record), *shared, ("WARC-Refers-To", f"<urn:page:{refers}:{sha.as_py()}>" if alone else None), ("X-Refers-To-Page", refers), ("WARC-Payload-Digest", digest), ("X-Payload-Length", size.as_py()), ("WARC-Segment-Number", 1)], b"")
                        yield (v,), len(v)
                        continue
                    running, payload = hashlib.sha1(), html.as_py().encode()
                    for k, block in enumerate(segments(payload, segment_bytes), 1):
                        running.update(block)
                        own = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record if k == 1 else f"{record[:-1]}:{k}>")]
                        own += [] if k == 1 else [("WARC-Segment-Origin-ID", record)]
                        v = _record([*own, *shared, ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", digest), ("X-Payload-Length", len(payload)), ("X-Running-Digest", "sha1:" + base32_sha1(running.digest())), ("WARC-Block-Digest", "sha1:" + base32_sha1(hashlib.sha1(block).digest())), ("WARC-Segment-Number", k)], block)
                        yield (v,), len(v)

        yield from arrow_rows(rows(), pa.schema([("value", pa.string())]))

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One WARC record (or chain of segments) for every row of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha"))
    copies = p.filter(F.col("size") >= min_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("sha").agg(F.max(F.struct("page_id", "n")).alias("k"), F.sum("n").alias("n")).filter("n > 1")
    copies = copies.select("sha", F.col("k.page_id").alias("keeper"), (F.col("k.n") == 1).alias("keeper_alone"))
    j = p.join(small(materialize(copies, "copies")), "sha", "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    alone = F.coalesce("keeper_alone", F.col("size") >= min_bytes)
    j = j.select("page_id", "url", F.when(refers.isNull(), F.col("html")).otherwise("").alias("html"), "size", "sha", refers.alias("refers"), alone.alias("alone"))
    j.mapInArrow(_written(segment_bytes), "value string").write.option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(batches):
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("said_digest", pa.string()), ("said_bytes", pa.int64()), ("running_digest", pa.string()), ("block", pa.binary())])

    def rows():
        for b in batches:
            for content in b.column(0):
                data = content.as_buffer().to_pybytes()
                at, gap = 0, GAP.encode()
                while at < len(data):
                    end = data.index(gap, at)
                    first, *lines = data[at:end].decode().split("\r\n")
                    if first != "WARC/1.1":
                        raise ValueError(f"no WARC record at byte {at}")
                    h = dict(x.split(": ", 1) for x in lines)
                    n = int(h["Content-Length"])
                    start = end + len(gap)
                    block, at = data[start : start + n], start + n + len(gap)
                    if len(block) != n or data[start + n : at] != gap:
                        raise ValueError("cut WARC record")
                    number = lambda k: None if h.get(k, "None") == "None" else int(h[k])
                    refers = h.get("X-Refers-To-Page")
                    yield (h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), int(h["WARC-Segment-Number"]), number("X-Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], refers and int(refers), h["WARC-Payload-Digest"][5:], int(h["X-Payload-Length"]), h.get("X-Running-Digest", "sha1:")[5:], block), n + 200

    yield from arrow_rows(rows(), schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: one row per record and chunk, read back from the archives."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, CHUNKS)


def _digested(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows():
        record, sha, size, head = None, None, 0, None

        def done():
            if head["record_type"] == "revisit":
                return (head["page_id"], head["said_bytes"], head["said_digest"], "revisit", head["refers_to"]), 100
            digest = base32_sha1(sha.digest())
            if (digest, size) != (head["said_digest"], head["said_bytes"]):
                raise ValueError(f"payload of {record} is not what its record says")
            return (head["page_id"], size, digest, "response", None), 100

        for b in batches:
            for row in b.to_pylist():
                if row["record_id"] != record:
                    if record is not None:
                        yield done()
                    record, sha, size, head = row["record_id"], hashlib.sha1(), 0, row
                sha.update(row["block"])
                size += len(row["block"])
                if row["record_type"] != "revisit" and base32_sha1(sha.digest()) != row["running_digest"]:
                    raise ValueError(f"chunk {row['chunk_no']} of {record} is damaged or missing")
        if record is not None:
            yield done()

    yield from arrow_rows(rows(), schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One verified row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    chunks = read_chunks(spark, path)
    whole = (F.col("record_type") == "revisit") | (F.col("chunk_no") == 1) & (F.col("said_bytes") == F.octet_length("block"))
    parts = chunks.filter(~whole).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return chunks.filter(whole).mapInArrow(_digested, out).unionByName(parts.mapInArrow(_digested, out))


def op3_warc_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    write_archives(pages, path)
    return read_records(spark, path)
