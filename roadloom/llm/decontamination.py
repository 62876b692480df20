"""Benchmark decontamination: token windows of documents against a broadcast set of test n-grams.

A window is 13 consecutive words of a benchmark item, or the whole item if it has fewer
words (but some). A document word inside any occurrence of a window is *hit*. The scan
looks rolling window hashes up in the broadcast set and then compares the words
themselves, so a hash collision is never a hit.

The benchmark is sent to the executors in slices of about ``max_windows`` windows, with long
items cut into runs of words that overlap by a window. Each slice is a scan of its own, whose
hits are stored before the next one begins: a larger benchmark means more scans, never a
larger broadcast, more live workers or another result.

Null or empty texts have no words and no hits; an item without words has no window.
Repeated documents are judged one by one, repeated items count once per ``item_id``, a
null item id counts as an item of its own whose name is the empty string. Columns other
than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.durable import Rounds
from roadloom.llm.rows import by_place, parts
from roadloom.llm.shipping import ship_package
from roadloom.llm.words import WordBlock, hash_runs, sums_by_text, word_blocks

WINDOW_WORDS = 13
MAX_WINDOWS = 500_000  # per slice: some 100 MB of short windows on each executor's worker
#: Contaminated: at least one word in 20 is hit.
HIT_SHARE = 20

WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Windows:
    """The windows of some benchmark items by length: sorted hashes, and the words with their items."""

    def __init__(self, items: list[tuple[object, str | None]], window_words: int = WINDOW_WORDS):
        self.words: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        hashes: dict[int, set[int]] = defaultdict(set)
        for block in word_blocks(pa.array([text for _, text in items], pa.string())):
            for i in range(block.texts):
                first, last = block.offsets[i], block.offsets[i + 1]
                length = min(window_words, last - first)
                if not length:
                    continue
                name = items[block.first + i][0]
                words = [block.word(w) for w in range(first, last)]
                hashes[length].update(hash_runs(block.hashes[first:last], length).tolist())
                for w in range(len(words) - length + 1):
                    self.words[length][b" ".join(words[w : w + length])].add("" if name is None else str(name))
        self.words = {length: dict(found) for length, found in self.words.items()}
        self.hashes = {length: np.array(sorted(found), np.uint64) for length, found in hashes.items()}
        self.heads = {}
        for length, found in self.hashes.items():
            self.heads[length] = np.zeros(1 << 16, bool)
            self.heads[length][found >> np.uint64(48)] = True

    def scan(self, block: WordBlock) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items found in each text."""
        hit, items, raw = np.zeros(len(block.starts), bool), defaultdict(set), None
        for length, hashes in self.hashes.items():
            if len(block.hashes) < length:
                continue
            rolling = hash_runs(block.hashes, length)
            likely = np.flatnonzero(self.heads[length][rolling >> np.uint64(48)])
            place = np.minimum(np.searchsorted(hashes, rolling[likely]), len(hashes) - 1)
            likely = likely[hashes[place] == rolling[likely]]
            text = np.searchsorted(block.offsets, likely, "right") - 1
            inside = likely + length <= block.offsets[text + 1]
            for first, where in zip(likely[inside].tolist(), text[inside].tolist()):
                raw = raw or block.data.tobytes()
                spans = zip(block.starts[first : first + length].tolist(), block.ends[first : first + length].tolist())
                found = self.words[length].get(b" ".join([raw[a:b] for a, b in spans]))
                if found:
                    hit[first : first + length] = True
                    items[where] |= found
        return hit, items


def item_runs(items: DataFrame, max_windows: int, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``(item_id, text)`` with the texts of long items as overlapping runs of words that have all their windows.

    Shorter items stay as they are; their words are as many as half their bytes at most.
    """
    step = max(1, max_windows // 4)
    long = F.octet_length("text") > 2 * step
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = F.expr(f"regexp_extract_all({lowered}, r'{WORD_CHARS}', 0)")
    runs = F.expr(
        f"transform(sequence(0, greatest(size(_words) - {window_words}, 0), {step}), "
        f"i -> array_join(slice(_words, i + 1, {step + window_words - 1}), ' '))"
    )
    cut = items.where(long).select("item_id", words.alias("_words")).select("item_id", F.explode(runs).alias("text"))
    return items.where(F.coalesce(~long, F.lit(False))).unionByName(cut)


def benchmark_slices(benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> Iterator[tuple[Windows, bool]]:
    """The benchmark's windows, about ``max_windows`` at a time, and whether they are the last ones."""
    items = benchmark.select("item_id", "text")
    # Words are one byte or more and have a gap between them, so this bounds the windows.
    bound = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    slices = max(1, math.ceil(bound / max_windows))
    if slices > 1:
        items = item_runs(items, max_windows)
    for k in range(slices):
        mine = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        yield Windows([tuple(row) for row in mine.toLocalIterator()]), k == slices - 1


HITS = (
    "STRUCT<n_words: BIGINT, n_hit: BIGINT, words: ARRAY<STRUCT<first: INT, last: INT>>,"
    " spans: ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>, items: ARRAY<STRING>>"
)


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str, keep: list[str], max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``hits``: the number of words, the hit words, and the items.

    ``hits.words`` are runs of hit words as [first, last) word numbers, ``hits.spans`` the
    same runs as [start, stop) bytes of the text in UTF-8.
    """
    spark = docs.sparkSession
    ship_package(spark)
    store = Rounds(spark, "hits")
    result = docs.select(text, *(c for c in keep if c != text), F.expr(f"CAST(NULL AS {HITS}) AS hits"))
    hits_type = F.expr(f"CAST(NULL AS {HITS})")
    for windows, last in benchmark_slices(benchmark, max_windows):
        sent = spark.sparkContext.broadcast(windows)
        names = [*keep, "hits"] if last else result.columns
        schema = result.select(*names[:-1], hits_type.alias("hits")).schema

        def scan(batches, sent=sent, names=tuple(names)):
            windows = sent.value
            for part in parts(batches, 0):
                known = part.column("hits").to_pylist()
                found = []
                for block in word_blocks(part.column(0)):
                    found += _block_hits(block, windows, known)
                columns = [part.column(name) for name in names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, part.schema.field("hits").type)], names=list(names))

        result = result.mapInArrow(scan, schema)
        if not last:
            # A scan by itself: chained scans would all be live in one task.
            result, _ = store.save(result)
            store.drop_superseded()
    return result


def _block_hits(block: WordBlock, windows: Windows, known: list[dict | None]) -> list[dict]:
    hit, items = windows.scan(block)
    before = [known[block.first + i] for i in range(block.texts)]
    for i, earlier in enumerate(before):
        for run in (earlier or {}).get("words") or ():
            hit[block.offsets[i] + run["first"] : block.offsets[i] + run["last"]] = True
            items[i] |= set(earlier["items"])
    n_hit, out = sums_by_text(hit, block.offsets), []
    for i in range(block.texts):
        row = {"n_words": int(block.counts[i]), "n_hit": int(n_hit[i]), "words": [], "spans": [], "items": []}
        if n_hit[i]:
            first, last = block.offsets[i], block.offsets[i + 1]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[first:last], [False]]).astype(np.int8)))
            row["words"] = [{"first": int(a), "last": int(b)} for a, b in edges.reshape(-1, 2)]
            row["spans"] = [
                {"start": int(block.starts[first + a] - block.text_offsets[i]), "stop": int(block.ends[first + b - 1] - block.text_offsets[i])}
                for a, b in edges.reshape(-1, 2)
            ]
            row["items"] = sorted(items[i])
        out.append(row)
    return out


def contaminated(hits: str = "hits"):
    """The rule for removing a document."""
    return F.expr(f"{hits}.n_hit > 0 AND {HIT_SHARE} * {hits}.n_hit >= {hits}.n_words")


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, columns as they were."""
    plain = by_place(docs)
    found = find_hits(plain, benchmark, f"c{docs.columns.index(text)}", plain.columns)
    return found.where(~contaminated()).drop("hits").toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what stands between neighbouring ones, cut out of the text."""
    plain, text = by_place(docs), f"c{docs.columns.index(text)}"
    pieces = F.expr(
        f"array_join(transform(sequence(0, size(hits.spans)), i -> decode(substring(encode({text}, 'UTF-8'),"
        " CAST(IF(i = 0, 1, hits.spans[greatest(i, 1) - 1].stop + 1) AS INT),"
        f" CAST(IF(i = size(hits.spans), octet_length({text}), hits.spans[least(i, size(hits.spans) - 1)].start)"
        " - IF(i = 0, 0, hits.spans[greatest(i, 1) - 1].stop) AS INT)), 'UTF-8')), '')"
    )
    cut = F.when(F.col("hits.n_hit") > 0, pieces).otherwise(F.col(text))
    return find_hits(plain, benchmark, text, plain.columns).withColumn(text, cut).drop("hits").toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: its words, its hit words, its items and whether it is contaminated."""
    scanned = find_hits(docs.select("doc_id", "text"), benchmark, "text", ["doc_id"])
    return scanned.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The report computed word by word, for small inputs."""
    import re

    pattern = re.compile(WORD_CHARS)
    split = lambda text: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    windows = []
    for name, text in items:
        words = split(text)
        length = min(WINDOW_WORDS, len(words))
        windows += [(words[i : i + length], "" if name is None else str(name)) for i in range(len(words) - length + 1) if length]
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for window, name in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(name)
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), names, bool(hit) and 20 * len(hit) >= len(words)))
    return out
