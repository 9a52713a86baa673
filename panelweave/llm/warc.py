"""WARC archives compressed record by record under a shared dictionary.

Each partition becomes one `.warc.zst` stream: a skippable frame with a Zstandard dictionary
that is built from a sample of the archived records, then one frame a record. Spark's text
writer stores them, so any store that Spark writes to will do and a lost task is redone.
Its separator after each record is itself an empty skippable frame, which readers pass over.

Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is a
response and the others revisit it; smaller payloads are all responses. Defined results: null
html is the empty payload; pages that share the largest page_id are responses; pages with a
null page_id are responses unless another page has their payload, and pages that are all
without one are responses; repeated rows each have a record; very long payloads are records
like any other; extra columns do not matter; an empty table has no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, shared_folder

# fixed values: magic numbers of the dictionary frame and of the separator frame
DICTIONARY_MAGIC, SEPARATOR = b"\x5d\x2a\x4d\x18", "P*M\x18\x00\x00\x00\x00"
DICTIONARY_BYTES = 64 * 1024
SAMPLE_BYTES = 8 << 20
CHUNK = 4 * 1024
LEVEL = 5
LEAST = 0
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP head; a revisit has the head alone, and says the full payload's size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A Zstandard dictionary trained on records, in pieces of CHUNK bytes; where they are too few to train on, they are the dictionary themselves."""
    pieces = [r[a : a + CHUNK] for r in records for a in range(0, len(r), CHUNK)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 4)
    if len(pieces) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError:  # the pieces have too little in common
            pass
    return b"".join(records) or b"WARC/1.1\r\n"


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def build_dictionary(pages: DataFrame, most: int = SAMPLE_BYTES) -> bytes:
    """From a sample of about `most` bytes of records: each row is drawn with the same chance by a hash."""
    total = pages.agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint") + F.lit(400))).first()[0]
    until = min(2**63 - 1, -(2**63) + int(min(1.0, most / max(1, total or 0)) * 2**64))
    sample = pages.filter(F.xxhash64(F.lit("dictionary"), "page_id", "url") <= F.lit(until)).select("page_id", "url", "html")

    def work(batches):
        texts = []
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                texts.append(record(page_id, url, payload, sha1_base32(payload), None, False))
        yield pa.RecordBatch.from_arrays([pa.array([dictionary_of(texts)], pa.binary())], names=["content"])

    # every task draws its part; the drawn rows, bounded by `most`, go to the one that trains, in a fixed order
    row = sample.repartition(1).sortWithinPartitions("page_id", "url", "html").mapInArrow(work, "content binary").first()
    return bytes(row[0]) if row else dictionary_of([])


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, and original: the page that the row revisits (null for a response).

    Which page revisits which is found on ids and digests alone. A payload that a large share
    of all pages has meets its group in a join that Spark can split, and payloads are joined
    to the revisits by page, never by digest.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = saved(rows.filter(F.octet_length("html") >= least).select("page_id", "digest"))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1 and original is not null").select("digest", "original")
    revisits = narrow.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("original"))).distinct()
    revisits = saved(revisits.select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "original"))
    found = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    return found.select("page_id", "url", "html", "original")


def write_archives(pages: DataFrame, path: str, least: int = LEAST, level: int = LEVEL) -> None:
    """Write pages (page_id, url, html) as .warc.zst streams below path."""
    content = build_dictionary(pages)

    def work(batches):
        tool = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(content), write_checksum=True)
        # no dictionary frame where there is no record
        lead = [DICTIONARY_MAGIC + len(content).to_bytes(4, "little") + content]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                frames = lead
                for page_id, url, html, original in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    payload = html.encode()
                    frames.append(tool.compress(record(page_id, url, payload, sha1_base32(payload), original, original is not None)))
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
                lead = []

    frames = planned(pages, least).mapInArrow(work, "frame binary")
    frames.select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", SEPARATOR).text(path)


def records_in(stream: bytes):
    """page_id, payload size, payload digest, type and referred page of each record of a .warc.zst stream."""
    if not stream.startswith(DICTIONARY_MAGIC):
        raise ValueError("no dictionary frame leads the stream")
    size = int.from_bytes(stream[4:8], "little")
    tool = zstandard.ZstdDecompressor(dict_data=_dictionary(stream[8 : 8 + size]))
    text = io.BufferedReader(tool.stream_reader(io.BytesIO(stream[8 + size :]), read_across_frames=True), 1 << 18)
    number = lambda name: int(name[10:-1]) if name[10:-1] else None
    while text.readline():
        head = {}
        while (line := text.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = text.read(int(head["Content-Length"]))
        text.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        told = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
        if kind == "response" and (len(payload) != told or sha1_base32(payload) != digest):
            raise ValueError(f"record {head['WARC-Record-ID']} does not hold its payload")
        yield number(head["WARC-Record-ID"]), told, digest, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, payload digests checked against the payloads."""

    def work(batches):
        for batch in batches:
            for stream in batch.column(0):
                view = stream.as_buffer().to_pybytes() if hasattr(stream, "as_buffer") else stream.as_py()
                rows = list(records_in(view)) if view else []
                if rows:
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(work, RECORD)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archives to a new place in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return read_archives(spark, path)
