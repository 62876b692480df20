"""WARC archives of single Zstandard frames behind a shared dictionary.

Each file is a series of Zstandard frames: first a skippable frame that holds the
dictionary, then a frame for every record, then, after each of these, an empty skippable
frame. That empty frame is a fixed byte string; decompressors pass over it, and it lets
Spark's text source write the records without a line feed between them and split a file
of any size into records when it reads it. The writer makes sure that no other frame holds
these bytes: a record that does is compressed in blocks that part them, and should a frame
hold them by accident, a filler header changes it.

The dictionary is built once from a bounded sample of the distinct payloads
(``SAMPLE_RECORDS`` with the lowest hashes, of each the first ``SAMPLE_BYTES``), so equal
tables give equal archives; with too little to build one from, the sample itself is the
dictionary. Very long payloads are one record each; an empty table gives no records.

Of pages with equal payloads the one with the smallest page id becomes a response record
and the others become revisit records that refer to it and carry no payload. A null
payload is an empty one. Null ids count as larger than all others; of equal rows one is
the response and each other one a revisit. Only the named columns are archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.durable import fresh_path
from roadloom.llm.shipping import ship_package

SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1_000, 16_384, 65_536, 3
#: Payloads below this size are always stored whole.
MIN_REVISIT_BYTES = 0

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = b"P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def _line(text: str) -> str:
    """A header value without what would end its line."""
    return "".join(c for c in text if c not in "\r\n")


def record(page_id: str | None, copy: int, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str, filler: int = 0) -> bytes:
    """A response record, or without a payload a revisit record."""
    block = HTTP_HEAD % size + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http;msgtype=response",
    ]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"] if payload is None else []
    head += [f"WARC-Filler: {filler}"] if filler else []
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, names in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples, or as many of them as fit where training can't be done."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_of(pages: DataFrame, payload: str) -> bytes:
    """The dictionary of the ``SAMPLE_RECORDS`` distinct payloads with the lowest hashes, or of all where there are fewer.

    The hashes are found first, as narrow rows, so tasks do not send payloads that are not
    sampled, however often payloads repeat.
    """
    filled = pages.where(F.octet_length(payload) > 0).select(F.col(payload).cast("binary").alias("p"), F.xxhash64(payload).alias("h"))
    lowest = [row.h for row in filled.select("h").distinct().orderBy("h").limit(SAMPLE_RECORDS).collect()]
    if not lowest:
        return b""
    sampled = filled.where(F.col("h") <= F.lit(lowest[-1])).groupBy("h").agg(F.first(F.substring("p", 1, SAMPLE_BYTES)).alias("p"))
    return build_dictionary([bytes(row.p) for row in sorted(sampled.collect(), key=lambda row: row.h)])


def _zdict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def framed(compressor: zstandard.ZstdCompressor, data: bytes) -> bytes:
    """One frame; bytes like the empty frame's are put into blocks that end amid them."""
    frame = compressor.compress(data)
    if EMPTY_FRAME not in frame:
        return frame
    half = len(EMPTY_FRAME) // 2
    head, *rest = data.split(EMPTY_FRAME)
    pieces = [head, *(EMPTY_FRAME[half:] + part for part in rest)]
    blocks = compressor.compressobj(size=len(data))
    out = []
    for i, piece in enumerate(pieces):
        out.append(blocks.compress(piece + (EMPTY_FRAME[:half] if i < len(rest) else b"")))
        out.append(blocks.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))
    return b"".join([*out, blocks.flush()])


def dictionary_frame(dictionary: bytes) -> bytes:
    content = framed(zstandard.ZstdCompressor(level=LEVEL), dictionary)
    if EMPTY_FRAME in content:
        raise ValueError("take another dictionary size: this dictionary's frame holds the bytes between records")
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def records_of(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """One row per record: responses with their payload, revisits with the page they refer to.

    Payloads move once, one per distinct payload out of each task, so a page that is copied
    a million times costs no more than one that is not.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    ).select("*", F.sha2("payload", 256).alias("key"), F.octet_length("payload").cast("long").alias("size"))
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    alike = F.col("size") >= MIN_REVISIT_BYTES
    firsts = rows.where(alike).groupBy("key", "size").agg(F.min(order).alias("first"), F.first("payload").alias("payload"))
    responses = firsts.select(
        "first.page_id", "first.url", "payload", "size", F.sha1("payload").alias("sha1"), F.lit(1).alias("copy"), F.lit(None).cast("string").alias("refers_to"),
    )
    # Narrow rows: what each page says of its payload, with equal rows counted.
    counted = rows.where(alike).groupBy("key", "page_id", "url", "size").agg(F.count(F.lit(1)).alias("n"), F.first(F.sha1("payload")).alias("sha1"))
    leaders = firsts.select("key", "first")
    same = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":1>"))
    revisits = counted.join(leaders, "key").where(~same | (F.col("n") > 1)).select(
        "page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "sha1",
        F.explode(F.sequence(F.when(same, 2).otherwise(1), F.col("n").cast("int"))).alias("copy"), name.alias("refers_to"),
    )
    parts = responses.unionByName(revisits)
    if MIN_REVISIT_BYTES > 0:
        small = rows.where(~alike).select("page_id", "url", "payload", "size", F.sha1("payload").alias("sha1"), F.lit(1).alias("copy"), F.lit(None).cast("string").alias("refers_to"))
        parts = parts.unionByName(small)
    return parts


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> None:
    """The pages as archives under ``path``, one file per task."""
    spark = pages.sparkSession
    ship_package(spark)
    dictionary = dictionary_of(pages, payload)
    sent = spark.sparkContext.broadcast(dictionary)

    def frames(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(sent.value), write_content_size=True)
        begun = False
        for batch in batches:
            out = []
            if not begun and batch.num_rows:
                begun = True
                out.append(dictionary_frame(sent.value))
            for page, copy, link, body, size, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "copy", "url", "payload", "size", "sha1", "refers_to"))):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                filler = 0
                while EMPTY_FRAME in (frame := framed(compressor, record(page, copy, link, body, size, name, refers, date, filler))):
                    filler += 1
                out.append(frame)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = records_of(pages, page_id, url, payload).withColumn("page_id", F.col("page_id").cast("string"))
    rows.mapInArrow(frames, "frame BINARY").select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_FRAME.decode()
    ).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page id, url, type, payload, its size and digest, and the page referred to."""
    ship_package(spark)
    frames = spark.read.option("lineSep", EMPTY_FRAME.decode()).text(path).select(F.col("value").cast("binary").alias("frame"))
    is_dictionary: Column = F.substring("frame", 1, 4) == F.lit(struct.pack("<I", DICTIONARY_MAGIC))
    # All files of one writer have the same dictionary, of at most DICTIONARY_BYTES.
    found = frames.where(is_dictionary).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("the archives come from different writers; read them one folder at a time")
    dictionary = zstandard.ZstdDecompressor().decompress(bytes(found[0].frame)[8:]) if found else b""
    sent = spark.sparkContext.broadcast(dictionary)

    def records(batches):
        decompressor = zstandard.ZstdDecompressor(dict_data=_zdict(sent.value))
        for batch in batches:
            out = []
            for frame in batch.column(0).to_pylist():
                headers, block = parse(decompressor.decompress(frame))
                if headers["warc-block-digest"] != f"sha1:{payload_digest(block)}":
                    raise ValueError(f"record {headers['warc-record-id']} is damaged")
                http, _, body = block.partition(b"\r\n\r\n")
                declared = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).partition(b":")[2])
                kind = headers["warc-type"]
                named = headers["warc-record-id"][len("<urn:page:") : -1].rpartition(":")[0]
                target = headers["warc-refers-to"][len("<urn:page:") : -1].rpartition(":")[0] if kind == "revisit" else ""
                if kind == "response" and (len(body) != declared or f"sha1:{payload_digest(body)}" != headers["warc-payload-digest"]):
                    raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
                out.append((named or None, headers.get("warc-target-uri"), kind, body if kind == "response" else None, declared,
                            headers["warc-payload-digest"].removeprefix("sha1:"), target or None))
            columns = list(zip(*out)) if out else [[]] * 7
            types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list("abcdefg"))

    return frames.where(~is_dictionary).mapInArrow(
        records, "page_id STRING, url STRING, record_type STRING, payload BINARY, payload_bytes BIGINT, payload_digest STRING, refers_to STRING"
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """The pages written as archives into the shared folder, and what the archives say of each page."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
