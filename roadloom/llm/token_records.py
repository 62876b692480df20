"""Token ids as length-delimited binary records, with an index of offsets for shuffled reads.

A file is a series of frames: the payload's length in 8 bytes, a masked CRC-32C of these,
the payload, a masked CRC-32C of the payload; numbers are little-endian. Any reader of such
records can read the files. A payload is a header and the ids of one document in 2 or 4
bytes each, whichever the vocabulary needs. After each document's frame stands a marker, a
frame with 16 fixed bytes made from the vocabulary file's digest: it lets Spark's text
source write the frames without line feeds and read a file of any size in splits. The ids
are scrambled by a number in the header, which is 0 unless the frame would hold the
marker's bytes by accident; then it is raised until it doesn't.

Documents are put into the order of their ids by range partitions, a file holds one range,
and a header says where in its file the frame begins and how many ids of the file stand
before it. The index is made by reading the files, with every checksum verified; sums over
the files give the number of ids before each document.

Null ids come first, rows of one id are in the order in which they were read; each row is a
record of its own. A null text is an empty one and has the end id
only. Very long texts are encoded about a megabyte at a time, cut before a space or line
feed that follows another character, where the vocabulary's pieces always end. An empty
table gives no records. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadloom.durable import fresh_path, write_and_read
from roadloom.llm.rows import parts
from roadloom.llm.shipping import ship_package

#: A worker that remembers the ids of more segments than this forgets them all.
REMEMBERED = 1_000_000
#: Segments that the library gets as one text.
JOINED = 100
#: Texts of more characters together are looked up one by one, so many segments at a time.
LONG_TEXT, SEGMENTS = 1 << 22, 1 << 18
END_ID = 0

# Fixed values of the frame format.
MASK_DELTA = 0xA282EAD8
CASTAGNOLI = 0x82F63B78

#: doc_id, ids of this file before the record, offset, number of the file, ids, whether there is a doc_id, bytes per id, scramble.
HEADER = struct.Struct("<qQQIIBBH")


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


@cache
def _pair_table() -> np.ndarray:
    """The remainder of each pair of bytes."""
    pairs = np.arange(1 << 16, dtype=np.uint32)
    first = _TABLE[pairs & 255]
    return _TABLE[(first ^ (pairs >> np.uint32(8))) & 255] ^ (first >> np.uint32(8))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given as what each of their four bytes becomes."""
    out = tables[0][crc & 255]
    for k in range(1, 4):
        out ^= tables[k][(crc >> np.uint32(8 * k)) & 255]
    return out


_shifts: list[np.ndarray] = []


def _shift(level: int) -> np.ndarray:
    """What 2^level zero bytes after it do to a checksum."""
    while len(_shifts) <= level:
        if not _shifts:
            values = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
            _shifts.append((values >> np.uint32(8)) ^ _TABLE[values & 255])
        else:
            before = _shifts[-1]
            _shifts.append(np.stack([_apply(before, row) for row in before]))
    return _shifts[level]


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The CRC-32C of each run ``data[offsets[i]:offsets[i + 1]]`` of bytes.

    Neighbours are joined level by level, each run padded in front to an even number:
    zeros in front don't change a remainder. What the start value adds depends on the
    length alone.
    """
    lengths = np.diff(offsets)
    run = data[offsets[0] : offsets[-1]]
    level = int(not (lengths & 1).any())
    counts = lengths >> level
    values = _pair_table()[np.ascontiguousarray(run).view("<u2")] if level else _TABLE[run]
    while len(values) and counts.max() > 1:
        odd = counts & 1
        padded = np.zeros(int(counts.sum() + odd.sum()), np.uint32)
        padded[np.arange(len(values)) + np.repeat(np.cumsum(odd), counts)] = values
        values = _apply(_shift(level), padded[0::2]) ^ padded[1::2]
        counts = (counts + odd) >> 1
        level += 1
    crc = np.zeros(len(lengths), np.uint32)
    crc[lengths > 0] = values
    start = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        has = (lengths >> k) & 1 == 1
        start[has] = _apply(_shift(k), start[has])
    return crc ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def _masked_of(pieces: list[bytes]) -> list[int]:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return masked(crc32c(np.frombuffer(b"".join(pieces), np.uint8), offsets)).tolist()


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload between its length and the checksums of both."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    checks = _masked_of([*lengths, *payloads])
    n = len(payloads)
    return [b"".join((lengths[i], struct.pack("<I", checks[i]), payloads[i], struct.pack("<I", checks[n + i]))) for i in range(n)]


def payloads(found: list[bytes]) -> list[bytes]:
    """What frames hold; a frame whose length or checksums don't fit raises."""
    if any(len(f) < 16 for f in found):
        raise ValueError("a record is shorter than its frame")
    bodies = [f[12:-4] for f in found]
    checks = _masked_of([*(f[:8] for f in found), *bodies])
    for i, frame in enumerate(found):
        length, check = struct.unpack_from("<QI", frame)
        if (length, check, struct.unpack("<I", frame[-4:])[0]) != (len(bodies[i]), checks[i], checks[len(found) + i]):
            raise ValueError("a record is damaged")
    return bodies


def marker(vocabulary: bytes) -> bytes:
    """The frame that stands after each record."""
    return frames([hashlib.sha256(vocabulary).digest()[:16]])[0]


def packed(doc_id: int | None, before: int, offset: int, file: int, ids: np.ndarray, width: int, scramble: int = 0) -> bytes:
    kind = np.uint16 if width == 2 else np.uint32
    head = HEADER.pack(doc_id or 0, before, offset, file, len(ids), doc_id is not None, width, scramble)
    return head + (ids.astype(kind) ^ kind(scramble)).astype(f"<u{width}").tobytes()


def frame_size(n_ids: int, width: int) -> int:
    return HEADER.size + width * n_ids + 16


def unpacked(payload: bytes) -> tuple[tuple, np.ndarray]:
    """The header's (doc_id, before, offset, file) and the ids."""
    doc_id, before, offset, file, n, known, width, scramble = HEADER.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", n, HEADER.size).astype(np.uint32) ^ np.uint32(scramble)
    return (doc_id if known else None, before, offset, file), ids


class Encoder:
    """The library's ids of whole texts, with those of frequent words remembered.

    The vocabulary's pieces hold white space only at their beginning or as a whole, so one
    always ends before a space or line feed that follows another character.
    """

    # Python counts all of the library's white space as such, and four control characters more.
    SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")

    def __init__(self, content: str):
        # A task has one core; threads of its own would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(content)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = described.get("added_tokens") or []
        # Texts are cut only where a byte-level vocabulary is known to; with others they are encoded whole.
        self.whole = (
            (described.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or described["pre_tokenizer"].get("add_prefix_space")
            or described.get("normalizer") is not None or any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        # A letter of a token stands for one byte; added tokens are plain text.
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        for token in added:
            self.sizes[token["id"]] = len(token["content"].encode())
        self._start_anew()

    SPACE = re.compile(r"\s")
    OTHER_SPACE = re.compile(r"[^\S \n]")

    def segments(self, text: str) -> list[str]:
        """The parts of a text that are encoded on their own; a space that begins one is left out, a mark says where none was.

        The mark is a space in front, so that what is left out and what isn't never look alike.
        """
        twice = "  " in text or "\n" in text and (" \n" in text or "\n " in text or "\n\n" in text)
        if not text or twice or text[0].isspace() or text[-1].isspace() or self.OTHER_SPACE.search(text):
            return self._marked(self.SEGMENT.findall(text))
        # Single spaces and line feeds between other characters: a part begins at each of them.
        first, *others = text.replace("\n", " \n").split(" ")
        return [" " + first, *others]

    def _marked(self, segments: list[str]) -> list[str]:
        marked = [s if s[0] == "\n" else s[1:] if s[0] == " " and s[1:2] not in ("", " ", "\n") else " " + s for s in segments]
        self.odd.update(s for s in marked if self.SPACE.search(s, 1))
        return marked

    @staticmethod
    def _text_of(segment: str) -> str:
        return segment[1:] if segment[0] == " " else segment if segment[0] == "\n" else " " + segment

    def _start_anew(self) -> None:
        """Segments' places in a table of ids laid end to end, and where each one's ids begin."""
        self.known: dict[str, int] = {}
        # Segments with white space behind their first character, or at their end.
        self.odd: set[str] = set()
        self.data, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _learn(self, segments: list[str]) -> None:
        """Have the library encode segments, many in one call; its tokens' sizes tell where each one ends."""
        # After one another only segments that begin and end as their neighbours in a text would.
        odd = self.odd
        alike = [s for s in segments if s[0] != " " and s not in odd]
        others = [s for s in segments if s[0] == " " or s in odd] if len(alike) < len(segments) else []
        joined = [(" " + " ".join(alike[i : i + JOINED])).replace(" \n", "\n") for i in range(0, len(alike), JOINED)]
        texts = list(map(self._text_of, others))
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined + texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        # The space that was left out is a byte as well.
        sizes = [len(s) + (s[0] != "\n") for s in alike] if all(map(str.isascii, joined)) else [len(s.encode()) + (s[0] != "\n") for s in alike]
        sizes += [len(t.encode()) for t in texts]
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1
        self.known.update(zip(alike + others, range(len(self.known), len(self.known) + len(segments))))
        self.starts = np.concatenate([self.starts, len(self.data) + stops.astype(np.int32)])
        self.data = np.concatenate([self.data, ids])

    def _looked_up(self, segments: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts, given as their segments."""
        flat = list(chain.from_iterable(segments))
        slots = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            self._learn(list({flat[i] for i in missing}))
            slots[missing] = [self.known[flat[i]] for i in missing]
        sizes = self.starts[slots + 1] - self.starts[slots]
        # A part's ids are far fewer than 2^31, and so are those remembered.
        stops = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=stops[1:])
        places = np.repeat(self.starts[slots] - stops[:-1], sizes)
        places += np.arange(stops[-1], dtype=np.int32)
        ids = self.data[places]
        texts = stops[np.cumsum([0, *map(len, segments)])]
        if len(self.known) > REMEMBERED:
            self._start_anew()
        return [ids[a:b] for a, b in zip(texts[:-1], texts[1:])]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of some texts, which are looked up together unless they are very long."""
        if self.whole:
            return [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) for text in texts]
        if sum(map(len, texts)) > LONG_TEXT:
            return [self._ids_of_long(text) for text in texts]
        return self._looked_up(list(map(self.segments, texts)))

    def _ids_of_long(self, text: str) -> np.ndarray:
        """The ids of one text, some of its segments at a time."""
        found, arrays = self.SEGMENT.finditer(text), [np.zeros(0, np.uint32)]
        while segments := [m.group() for m in islice(found, SEGMENTS)]:
            arrays += self._looked_up([self._marked(segments)])
        return np.concatenate(arrays)

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """The encoder of a vocabulary file's content, built once per worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _options(path_mark: bytes) -> dict[str, str]:
    return {"encoding": "ISO-8859-1", "lineSep": path_mark.decode("latin-1")}


def write_records(
    docs: DataFrame, path: str, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> None:
    """The documents' ids, each followed by ``end_id``, as files under ``path`` in the order of ``doc_id``.

    The vocabulary file is read where the driver runs and sent to the executors; it is a
    fixed file of a few megabytes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read()
    sent, mark = spark.sparkContext.broadcast(content), marker(content.encode())

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = encoder(sent.value)
        file, before, offset = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], np.uint32)
        for part in parts(batches, 1):
            rows = []
            texts = [text or "" for text in part.column(1).to_pylist()]
            for name, ids in zip(part.column(0).to_pylist(), words.ids_of(texts)):
                ids = np.concatenate([ids, end])
                rows.append((name, before, offset, file, ids, words.width))
                before += len(ids)
                offset += frame_size(len(ids), words.width) + len(mark)
            out = frames([packed(*row) for row in rows])
            for i, frame in enumerate(out):
                scramble = 0
                while mark in frame:
                    scramble += 1
                    frame = frames([packed(*rows[i], scramble)])[0]
                out[i] = frame
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row")
    )
    order = ["doc_id", "_row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(run, "frame BINARY").select(F.col("frame").cast("string").alias("value")).write.options(
        **_options(mark)
    ).option("compression", "none").text(path)


RECORDS = "file INT, offset BIGINT, size BIGINT, before BIGINT, doc_id BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"


def read_records(spark: SparkSession, path: str, vocabulary_path: str, with_ids: bool = False) -> DataFrame:
    """A row per record, with its place in its file; checksums are verified.

    ``before`` is the number of ids before it in the file, ``ids_crc32`` goes over the ids
    as 32-bit numbers.
    """
    ship_package(spark)
    with open(vocabulary_path, "rb") as file:
        mark = marker(file.read())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in payloads(batch.column(0).to_pylist()):
                (doc_id, before, offset, file), ids = unpacked(payload)
                plain = ids.astype("<u4")
                rows.append((file, offset, len(payload) + 16, before, doc_id, len(ids), zlib.crc32(plain.tobytes()), *([plain.astype(np.int32)] * with_ids)))
            kinds = [pa.int32(), *[pa.int64()] * 6, *([pa.list_(pa.int32())] * with_ids)]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f"c{i}" for i in range(len(kinds))])

    lines = spark.read.options(**_options(mark)).text(path).select(F.col("value").cast("binary").alias("frame"))
    return lines.mapInArrow(run, RECORDS + ", ids ARRAY<INT>" * with_ids)


def write_index(records: DataFrame, path: str) -> DataFrame:
    """The stored index of ``records`` under ``path``, with ``start``: the ids of all documents before each.

    One row per file is summed up in order; their number is set by the writer's session.
    """
    stored, _ = write_and_read(records.select(*[part.split()[0] for part in RECORDS.split(", ")]), f"{path}/places")
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("_ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_first"))
    return stored.join(F.broadcast(firsts), "file").select("*", (F.col("_first") + F.col("before")).alias("start")).drop("_first")


def shuffled(index: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """The index in the order of a hash of place, seed and epoch: where each record of a shuffled pass is read.

    Range partitions hold runs of the order; ``turn`` is a record's key in it.
    """
    key = F.xxhash64(F.lit(seed).cast("long"), F.lit(epoch).cast("long"), "file", "offset")
    return index.withColumn("turn", key).repartitionByRange("turn", "file", "offset").sortWithinPartitions("turn", "file", "offset")


def read_at(stream, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """The document id and the ids of one record of an open file."""
    stream.seek(offset)
    (doc_id, _, _, _), ids = unpacked(payloads([stream.read(size)])[0])
    return doc_id, ids


def report(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The documents written as records into the shared folder, and what the files say of each."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-records")
    write_records(docs, f"{path}/data", vocabulary_path)
    index = write_index(read_records(spark, f"{path}/data", vocabulary_path), f"{path}/index")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "size")
