"""Ranked lexical search with a tree over the items and a tree over the documents.

A document is a sparse vector: for each term its saturated frequency, ``(10^9 * tf) div
(1000 * tf + 8 * m)``, where ``m`` grows with the document's length. An item is one as
well: the weight of each of its terms. The score of a pair is their inner product, all in
whole numbers.

Nodes of both trees hold the greatest coordinate of what is below them, term by term. The
inner product of two nodes is therefore a bound on every pair below them, and a pair of
nodes goes if it stays below the weakest k-th best score among the node's items. Otherwise
the wider one of the two is opened. For a single item the documents' nodes with the best
bounds are opened first, so that its k-th score rises early. Bounds and scores are exact
whole numbers, and equality never prunes, so the result is exact, ties included.

One pass over the texts finds the terms of items in each document, confirmed byte by byte,
and stores them as vectors; the number of documents, their lengths and the document
frequencies are counted over all of it. A share of the vectors is searched first, which
gives the k-th scores that all tasks start from; then all vectors are searched, a bounded
number at a time, and the tasks' best rows are ranked together. Items are sent to the
tasks in slices of a bounded number of words, one slice after the other.

A null text has no terms. Each row of the documents is a document, also where ids repeat;
of equally good ones that with the lower id comes first, null before all. Rows of the items
with one id are one item with the terms of all of them; null is an id like others. Items
without terms and empty tables give no rows. Ids of documents must be whole numbers; other
columns are not read. A very long text is read as a whole and becomes one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.durable import durable, fresh_path, write_and_read
from roadloom.llm.rows import parts, release_memory
from roadloom.llm.shipping import ship_package
from roadloom.llm.words import WordBlock, word_blocks

BEST = 10
#: About as many words of items are sent at a time; an item is never cut.
SLICE_WORDS = 1 << 16
#: Vector entries and matrix cells of the documents that one tree is built over.
TREE_ENTRIES, TREE_CELLS = 1 << 20, 1 << 22
FAN_OUT = 8
#: One vector in so many is searched first, for k-th scores.
SEED_SHARE = 16


class Terms:
    """The distinct terms of some items, found in texts by their hashes and confirmed by their bytes."""

    def __init__(self, items: list[tuple[object, str | None]]):
        texts = pa.array([text for _, text in items], pa.string())
        by_word: dict[bytes, int] = {}
        of_item: dict[object, set[int]] = {}
        hashes: list[int] = []
        for block in word_blocks(texts):
            for i in range(block.texts):
                own = of_item.setdefault(items[block.first + i][0], set())
                for j in range(block.offsets[i], block.offsets[i + 1]):
                    word = block.word(j)
                    if word not in by_word:
                        by_word[word] = len(by_word)
                        hashes.append(int(block.hashes[j]))
                    own.add(by_word[word])
        self.names = [name for name, own in of_item.items() if own]
        self.of_item = [np.array(sorted(own), np.int64) for own in of_item.values() if own]
        self.count = len(by_word)
        plain = np.array(hashes, np.uint64)
        self.order = np.argsort(plain, kind="stable")
        self.hashes = plain[self.order]
        # Different terms of one hash would follow each other here.
        self.most_alike = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))
        words = list(by_word)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def find(self, block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a block are terms, and which term each of these is."""
        where, which = [], []
        place = np.searchsorted(self.hashes, block.hashes)
        for k in range(self.most_alike):
            at = np.minimum(place + k, max(0, self.count - 1))
            words = np.flatnonzero(self.hashes[at] == block.hashes) if k == 0 else np.flatnonzero((place + k < self.count) & (self.hashes[at] == block.hashes))
            terms = self.order[at[words]]
            same = self.sizes[terms] == (block.ends - block.starts)[words]
            words, terms = words[same], terms[same]
            if len(words):
                sizes = self.sizes[terms]
                firsts = np.cumsum(sizes) - sizes
                step = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
                equal = block.data[np.repeat(block.starts[words], sizes) + step] == self.data[np.repeat(self.starts[terms], sizes) + step]
                same = np.logical_and.reduceat(equal, firsts)
                words, terms = words[same], terms[same]
            where.append(words)
            which.append(terms)
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Found:
    """A slice's stored vectors and the counts over all documents."""

    vectors: DataFrame
    documents: int
    words: int
    frequencies: np.ndarray


VECTORS = "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, counts ARRAY<INT>"


def vectors_of(docs: DataFrame, terms: Terms, doc_id: str, text: str) -> Found:
    """The terms of each document and how often they occur, stored, and the counts over all documents."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for part in parts(batches, 1):
            for block in word_blocks(part.column(1)):
                words, which = terms.find(block)
                document = np.searchsorted(block.offsets, words, "right") - 1
                keys, counts = np.unique(document * max(1, terms.count) + which, return_counts=True)
                firsts = np.searchsorted(keys // max(1, terms.count), np.arange(block.texts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(block.first, block.texts), pa.array(block.counts.astype(np.int64)),
                     pa.ListArray.from_arrays(firsts, (keys % max(1, terms.count)).astype(np.int32)), pa.ListArray.from_arrays(firsts, counts.astype(np.int32))],
                    names=["doc_id", "n", "terms", "counts"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vectors, seen = write_and_read(
        rows.mapInArrow(scan, VECTORS), fresh_path(spark, "vectors"), documents=F.expr("count_if(n > 0)"), words=F.expr("coalesce(sum(n), 0)"),
    )
    size = terms.count

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    # One row per term of the slice.
    counted = vectors.select("terms").mapInArrow(count, "term BIGINT, df BIGINT").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    frequencies = np.zeros(size, np.int64)
    frequencies[counted["term"].to_numpy()] = counted["df"].to_numpy()
    return Found(vectors, seen["documents"], seen["words"], frequencies)


def term_weights(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


class ItemNode:
    """Some items: the terms that any of them has, and the nodes below."""

    def __init__(self, items: list[int], terms: np.ndarray, below: list["ItemNode"]):
        self.items, self.terms, self.below = items, terms, below


def item_tree(of_item: list[np.ndarray], weights: np.ndarray) -> ItemNode:
    """Items whose weightiest terms are the same stand together."""
    by_weight = [tuple(sorted(terms.tolist(), key=lambda t: (-weights[t], t))) for terms in of_item]
    level = [ItemNode([i], of_item[i], []) for i in sorted(range(len(of_item)), key=by_weight.__getitem__)]
    while len(level) > 1:
        groups = [level[i : i + FAN_OUT] for i in range(0, len(level), FAN_OUT)]
        level = [ItemNode([i for n in g for i in n.items], np.unique(np.concatenate([n.terms for n in g])), g) for g in groups]
    return level[0]


class DocumentTree:
    """Levels of coordinate maxima over some documents: level 0 holds the documents themselves."""

    def __init__(self, ids: pa.Array, firsts: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray):
        n = len(firsts) - 1
        row = np.repeat(np.arange(n), np.diff(firsts))
        # Documents whose weightiest term is the same stand together.
        gain = weights[terms] * values
        lead = np.full(n, -1)
        best = np.lexsort((terms, -gain, row))
        begins = np.flatnonzero(np.diff(firsts) > 0)
        lead[begins] = terms[best[firsts[:-1][begins]]]
        order = np.argsort(lead, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.ids = ids.take(pa.array(order))
        self.used, column = np.unique(terms, return_inverse=True)
        cells = np.zeros((n, len(self.used)), np.int64)
        cells[rank[row], column] = values
        self.levels = [cells]
        while len(self.levels[-1]) > FAN_OUT:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN_OUT), axis=0))

    def columns_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of those terms that any document has, and the terms."""
        place = np.minimum(np.searchsorted(self.used, terms), max(0, len(self.used) - 1))
        has = self.used[place] == terms if len(self.used) else np.zeros(len(terms), bool)
        return place[has], terms[has]


class Search:
    """The best documents of each item so far."""

    def __init__(self, root: ItemNode, items: int, weights: np.ndarray, keep: int, floor: np.ndarray | None):
        self.root, self.weights, self.keep = root, weights, keep
        self.least = np.maximum(np.ones(items, np.int64), floor if floor is not None else 1)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.pairs = 0

    def add(self, tree: DocumentTree) -> None:
        """Search the documents of a tree."""
        self.tree, self.columns = tree, {}
        top = len(tree.levels) - 1
        self._visit(self.root, top, np.arange(len(tree.levels[top])))

    def _bounds(self, node: ItemNode, level: int, rows: np.ndarray) -> np.ndarray:
        known = self.columns.get(id(node))
        if known is None:
            columns, terms = self.tree.columns_of(node.terms)
            known = self.columns[id(node)] = columns, self.weights[terms]
        columns, weights = known
        self.pairs += len(rows)
        return self.tree.levels[level][rows[:, None], columns] @ weights

    def _visit(self, node: ItemNode, level: int, rows: np.ndarray) -> None:
        bounds = self._bounds(node, level, rows)
        reach = bounds >= self.least[node.items].min()
        rows, bounds = rows[reach], bounds[reach]
        if not len(rows):
            return
        if not node.below and not level:
            self._take(node.items[0], rows, bounds)
        elif node.below and (not level or len(node.items) * FAN_OUT >= FAN_OUT**level):
            for below in node.below:
                self._visit(below, level, rows)
        elif not node.below:
            order = np.argsort(-bounds, kind="stable")
            first, rest = order[:FAN_OUT], order[FAN_OUT:]
            self._visit(node, level - 1, self._open(level, rows[first]))
            rest = rest[bounds[rest] >= self.least[node.items[0]]]
            if len(rest):
                self._visit(node, level - 1, self._open(level, rows[rest]))
        else:
            self._visit(node, level - 1, self._open(level, rows))

    def _open(self, level: int, rows: np.ndarray) -> np.ndarray:
        """The nodes below some nodes of a level."""
        below = (rows[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
        return below[below < len(self.tree.levels[level - 1])]

    def _take(self, item: int, rows: np.ndarray, scores: np.ndarray) -> None:
        if len(rows) > self.keep:
            # Only rows that reach the k-th score of these alone can be among the best.
            reach = scores >= np.partition(scores, len(scores) - self.keep)[len(scores) - self.keep]
            rows, scores = rows[reach], scores[reach]
        ids = self.tree.ids.take(pa.array(rows)).to_pylist()
        found = self.best[item] + [(-s, i is not None, i or 0) for s, i in zip(scores.tolist(), ids)]
        self.best[item] = found = sorted(found)[: self.keep]
        if len(found) == self.keep:
            self.least[item] = max(self.least[item], -found[-1][0])

    def table(self) -> pa.RecordBatch:
        rows = [(item, i if known else None, -s) for item, found in enumerate(self.best) for s, known, i in found]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])


def frequencies_of(counts: np.ndarray, firsts: np.ndarray, lengths: list[int], documents: int, words: int) -> np.ndarray:
    """The saturated frequency of each vector entry; lengths are multiplied as numbers of any size."""
    m = np.array([100 - 90 + 90 * n * documents // words for n in lengths], np.int64)
    tf = counts.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(firsts)))


def _trees(batch: pa.RecordBatch, found: tuple[int, int], weights: np.ndarray) -> Iterator[DocumentTree]:
    """Trees over the rows of a batch, each of bounded size or of one document."""
    documents, words = found
    offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
    terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
    offsets -= offsets[0]
    lengths = batch.column(1).to_pylist()
    first, rows = 0, batch.num_rows
    while first < rows:
        most = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TREE_ENTRIES, "right")) - 1)
        used = len(np.unique(terms[offsets[first] : offsets[most]]))
        last = min(most, first + max(1, TREE_CELLS // max(1, used)))
        firsts = offsets[first : last + 1] - offsets[first]
        own = slice(offsets[first], offsets[last])
        if firsts[-1]:
            values = frequencies_of(counts[own], firsts, lengths[first:last], documents, words)
            yield DocumentTree(batch.column(0).slice(first, last - first), firsts, terms[own].astype(np.int64), values, weights)
        first = last


def _searched(vectors: DataFrame, terms: Terms, found: Found, weights: np.ndarray, keep: int, floor: np.ndarray | None) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((terms.of_item, weights, floor, (found.documents, found.words)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        of_item, weights, floor, totals = sent.value
        search = Search(item_tree(of_item, weights), len(of_item), weights, keep, floor)
        for batch in batches:
            for tree in _trees(batch, totals, weights):
                search.add(tree)
        yield search.table()
        release_memory()

    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    rows = vectors.where(F.size("terms") > 0).mapInArrow(run, "item INT, doc_id BIGINT, score BIGINT")
    return rows.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= keep)


def item_slices(items: DataFrame, item_id: str, text: str, words: int = SLICE_WORDS) -> Iterator[Terms]:
    """The items, about so many words at a time; all rows of one id together."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text"))
    # Words are one byte or more and have a gap between them, so this bounds their number.
    bound = rows.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    slices = max(1, math.ceil(bound / words))
    for k in range(slices):
        mine = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
        yield Terms([tuple(row) for row in mine.toLocalIterator()])


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the ``best`` documents of each item."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = items.schema[item_id].dataType
    result = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank INT, doc_id BIGINT, score BIGINT")
    for terms in item_slices(items, item_id, item_text):
        if not terms.names:
            continue
        found = vectors_of(docs, terms, doc_id, text)
        weights = term_weights(found.documents, found.frequencies)
        seeds = _searched(found.vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0), terms, found, weights, best, None)
        kth = seeds.where(F.col("rank") == best).select("item", "score").toArrow()
        floor = np.ones(len(terms.names), np.int64)
        floor[kth["item"].to_numpy()] = kth["score"].to_numpy()
        ranked = _searched(found.vectors, terms, found, weights, best, floor)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(terms.names)], f"item INT, item_id {kind.simpleString()}")
        # One row per item of the slice.
        result = result.unionByName(durable(ranked.join(F.broadcast(names), "item").select(*result.columns), "ranked"))
    return result


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(docs, benchmark)
