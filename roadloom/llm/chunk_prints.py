"""Fingerprints of documents: digests of chunks whose boundaries depend on content.

A gear hash runs over the UTF-8 bytes: each byte shifts it by one bit and adds the byte's
entry of a table, so it depends on the last 32 bytes only. A chunk ends where some of the
hash's high bits are zero; before the normal size more bits are asked for than after it, so
sizes keep close to the normal one, and no chunk is smaller than ``MIN`` or larger than
``MAX``. An insertion moves bytes, not boundaries: behind the edit the old chunks return.

A fingerprint is the set of chunk digests with the chunks' sizes, written as
``digest:size`` in order of the digests. The likeness of one fingerprint to another is
the share of its bytes, each distinct chunk once, that lies in chunks of the other. Equal
texts have equal fingerprints and likeness 1; two empty ones are alike, an empty one and
another are not.

For the edited texts every document needs the beginning of the next one by id. Documents
are dealt to ranges of (id, text hash) cut at sampled rows; the first row of each range is
also given to the range before it, so each range is read in one pass by a task of its own
and no text moves twice. Null ids come first; rows of one id are ordered by their texts'
hashes; of equal rows it doesn't matter which is which. Null texts are empty.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.labelled import among_lowest
from roadloom.llm.shipping import ship_package
from roadloom.llm.words import mix

MIN, NORMAL, MAX = 16, 64, 256
#: Zero bits asked for before and after the normal size.
STRICT_BITS, LOOSE_BITS = 8, 4
DIGEST_BYTES = 6
#: Bytes per range, and the most ranges: the driver keeps one id and one hash for each.
RANGE_BYTES = 8 << 20
MAX_RANGES = 131_072
#: Ranges per partition: several even out how they are dealt.
RANGES_TOGETHER = 4

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

Print = dict[bytes, int]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash after each byte, over the 32 bytes up to it, by doubling the span five times."""
    hashes = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        doubled = hashes.copy()
        doubled[shift:] += hashes[:-shift] << np.uint32(shift)
        hashes = doubled
    return hashes


def chunk_ends(data: np.ndarray, start: int = 0) -> list[int]:
    """Where the chunks from ``start`` on end; ``start`` is 0 or the end of a chunk."""
    size = len(data)
    # Of the hash, only bytes within reach of the first possible end are needed.
    reach = max(0, start - 32)
    hashes = gear_hashes(data[reach:])
    loose_at = np.flatnonzero(hashes >> np.uint32(32 - LOOSE_BITS) == 0)
    strict_at = (loose_at[hashes[loose_at] >> np.uint32(32 - STRICT_BITS) == 0] + reach + 1).tolist()
    loose_at = (loose_at + reach + 1).tolist()
    ends, at = [], start
    while size - at > MIN:
        i = bisect_left(strict_at, at + MIN)
        if i < len(strict_at) and strict_at[i] < at + NORMAL:
            at = strict_at[i]
        else:
            i = bisect_left(loose_at, at + NORMAL)
            at = min(loose_at[i] if i < len(loose_at) else size, at + MAX, size)
        ends.append(at)
    if at < size:
        ends.append(size)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()


def fingerprint(data: bytes) -> tuple[Print, list[int]]:
    """Chunk digests with their sizes, and the chunks' ends."""
    ends = chunk_ends(np.frombuffer(data, np.uint8))
    return {digest(data[a:b]): b - a for a, b in zip([0, *ends], ends)}, ends


def fingerprint_after(data: bytes, kept: int, before: bytes, ends: list[int]) -> Print:
    """The fingerprint of ``data``, whose first ``kept`` bytes are those of ``before`` with chunk ``ends``."""
    # An end is where it was if the bytes up to it are the same, except for the text's own end.
    same = ends[: bisect_right(ends, kept)]
    if same and same[-1] == len(before):
        same.pop()
    start = same[-1] if same else 0
    now = same + chunk_ends(np.frombuffer(data, np.uint8), start)
    return {digest(data[a:b]): b - a for a, b in zip([0, *now], now)}


def written(chunks: Print) -> str:
    return " ".join([f"{base64.b64encode(d).decode()}:{chunks[d]}" for d in sorted(chunks)])


def likeness(mine: Print, other: Print) -> float:
    """The share of my bytes in chunks that the other has too."""
    if not mine:
        return 1.0 if not other else 0.0
    return sum(size for d, size in mine.items() if d in other) / sum(mine.values())


def read_print(text: str) -> Print:
    """A fingerprint from its written form."""
    return {base64.b64decode(d): int(size) for d, _, size in (part.partition(":") for part in text.split())}


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with the text's ``fingerprint``."""
    ship_package(docs.sparkSession)
    schema = docs.select(*keep, F.lit("").alias("fingerprint")).schema

    def run(batches):
        for batch in batches:
            prints = [written(fingerprint((one.as_py() or "").encode())[0]) for one in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints, pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def by_ranges(docs: DataFrame, doc_id: str, text: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``(range, doc_id, hash, ahead, text)``: all of each range, and ``ahead`` the first row after it."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.col(doc_id).isNotNull().alias("_known"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
    )
    key = F.struct("_known", "doc_id", "hash")
    extent = rows.agg(F.sum(F.octet_length("text")), F.min(key), F.count(F.lit(1))).first()
    if extent[1] is None:
        return rows.select(F.lit(0).alias("range"), "doc_id", "hash", F.lit(False).alias("ahead"), "text")
    ranges = min(MAX_RANGES, extent[0] // range_bytes + 1)
    # Rows with low hashes are a fair sample, the same at every run; equal rows are one.
    keys = rows.select(key.alias("k"), F.xxhash64(key).alias("h"))
    sampled = keys.where(among_lowest(F.col("h"), ranges, extent[2])).distinct().orderBy("h", "k").limit(ranges - 1).collect() if ranges > 1 else []
    plain = lambda k: (k[0], k[1] if k[0] else 0, k[2])
    first = plain(extent[1])
    heads = [first, *sorted({plain(row.k) for row in sampled} - {first})]

    @F.pandas_udf("array<struct<range: int, ahead: boolean>>")
    def places(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for k, i, h in zip(known, ids, hashes):
            own = (k, i if k else 0, h)
            at = bisect_right(heads, own) - 1
            found = [{"range": at, "ahead": False}]
            if heads[at] == own:
                found.append({"range": (at - 1) % len(heads), "ahead": True})
            out.append(found)
        return pd.Series(out)

    # A null id travels as some other value so that all ids keep their exact type.
    filled = F.coalesce("doc_id", F.lit(0).cast(rows.schema["doc_id"].dataType))
    placed = rows.withColumn("_places", places("_known", filled, "hash")).select(
        F.explode("_places").alias("_place"), "doc_id", "_known", "hash", "text"
    )
    return placed.select("_place.range", "doc_id", "_known", "hash", "_place.ahead", "text").repartition(
        len(heads) // RANGES_TOGETHER + 1, "range"
    ).sortWithinPartitions("range", "ahead", "_known", "doc_id", "hash").select("range", "doc_id", "hash", "ahead", "text")


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited form, and the likeness to that and to the next text.

    Edited: the last quarter of the code points gives way to as many of the next document.
    """
    ship_package(docs.sparkSession)
    rows = by_ranges(docs, doc_id, text, range_bytes)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING,"
        " near_edited DOUBLE, near_next DOUBLE"
    )

    def compared(one, following):
        doc, body, data, (mine, ends) = one
        changed = len(body) // 4
        kept = body[: len(body) - changed]
        edited = (kept + following[1][:changed]).encode()
        other = fingerprint_after(edited, len(kept.encode()), data, ends)
        return (doc, len(body), hashlib.sha256(edited).hexdigest(), written(mine), written(other),
                likeness(mine, other), likeness(mine, following[3][0]))

    def run(batches):
        names = [part.split()[0] for part in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before, in_range, done, volume, id_type = None, None, [], 0, None
        full = lambda: pa.RecordBatch.from_arrays(
            [pa.array(column, t) for column, t in zip(zip(*done), [id_type, *types])], names=names
        )
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at, doc, ahead, body in zip(*(batch.column(c) for c in ("range", "doc_id", "ahead", "text"))):
                at, ahead, body = at.as_py(), ahead.as_py(), body.as_py()
                if at != in_range:
                    in_range, before = at, None
                if before is None and ahead:
                    continue  # the range's end came already; equal rows may lie ahead
                data = body.encode()
                own = (doc.as_py(), body, data, fingerprint(data))
                if before is not None:
                    done.append(compared(before, own))
                    volume += len(before[2])
                before = None if ahead else own
            if volume > 16 << 20 or len(done) > 20_000:
                yield full()
                done, volume = [], 0
        if done:
            yield full()

    return rows.mapInArrow(run, schema)
