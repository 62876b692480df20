"""Hard negatives by vertical scans over blocks of columns.

Vectors are laid out in blocks, each holding its rows' components column by column with
the least and the greatest value of each. A scan takes an anchor's dimensions in the order
of descending magnitude. After each few columns the known part of a row's score plus the
least and the greatest that the columns not yet read can add bounds it, and the bitmap of
candidates shrinks to the rows whose bounds still allow a result: for positives, those that
can reach the k-th best score found; for negatives, those that can fall into a window and
are not beaten by the k-th best score found inside it. Rows that stay to the end have
exact scores. The bounds never drop a row that belongs to the result, ties included.

Blocks are filled in the order of labels, so a scan passes over blocks whose labels or
bounds can't matter. Anchors are sent to the tasks in slices of bounded size, one after the
other; a share of the blocks is scanned first, and the scores found there let the other
tasks start with good thresholds. No row is left out: the second scan reads all blocks.

Rows with a null id, label or vector, or with a null or non-finite component take no part.
Rows are told apart by their id: of several with one id the lowest (label, vector) counts.
Vectors of unequal length are compared as if the shorter one went on with zeros. Scores
must stay below 2^55; components too large for that raise. Columns other than the named ones
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.durable import durable
from roadloom.llm.rows import release_memory
from roadloom.llm.shipping import ship_package

#: Components of a block, and of the anchors that are sent at a time.
BLOCK_CELLS, SLICE_CELLS, SLICE_ANCHORS = 1 << 18, 1 << 21, 8_192
#: One block in so many is scanned first, for thresholds.
SEED_SHARE = 16
#: Columns read before the bounds are looked at again; later steps are twice as long.
FIRST_STEP = 4
LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Windows:
    """How many positives and negatives, and the negatives' share of the positive's score in hundredths."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable(embeddings: DataFrame, scale: int = 256, vec_id: str = "vec_id", label="label", vector: str = "embedding") -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part, components scaled and rounded down."""
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(vector).cast("array<double>").alias("given"))
    finite = F.forall("given", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is greater than infinity
    whole = F.transform("given", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("given").isNotNull() & finite)
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("_row")).select("vec_id", "_row.label", "_row.vector")


class Block:
    """Some rows, their components column by column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low = columns.min(axis=1).astype(np.int64) if columns.size else np.zeros(len(columns), np.int64)
        self.high = columns.max(axis=1).astype(np.int64) if columns.size else np.zeros(len(columns), np.int64)

    @classmethod
    def of(cls, ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> "Block":
        sizes = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        rows = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = values
        return cls(ids.to_numpy(), labels.to_numpy(), np.ascontiguousarray(rows.T))

    def packed(self) -> dict:
        """Columns in the fewest bytes that hold them."""
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not self.columns.size or np.iinfo(t).min <= self.low.min() and self.high.max() <= np.iinfo(t).max)
        return {"rows": len(self.ids), "ids": self.ids.astype("<i8").tobytes(), "labels": self.labels.astype("<i8").tobytes(),
                "width": np.dtype(kind).itemsize, "columns": self.columns.astype(kind).tobytes()}

    @classmethod
    def read(cls, row: dict) -> "Block":
        n = row["rows"]
        columns = np.frombuffer(row["columns"], f"<i{row['width']}")
        return cls(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), columns.reshape(-1, n))


BLOCKS = "rows INT, ids BINARY, labels BINARY, width INT, columns BINARY"


def column_blocks(vectors: DataFrame) -> DataFrame:
    """The vectors as stored blocks of columns, rows of one label and one leading dimension together."""
    ship_package(vectors.sparkSession)

    def lay_out(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first = batch.num_rows, 0
            vectors = batch.column(2)
            while first < rows:
                width = max(1, len(vectors[first]))
                part = batch.slice(first, max(1, BLOCK_CELLS // width))
                widest = max(width, int(np.diff(part.column(2).offsets.to_numpy()).max()))
                part = part.slice(0, max(1, min(part.num_rows, BLOCK_CELLS // widest)))
                first += part.num_rows
                yield pa.RecordBatch.from_pylist([Block.of(part.column(0), part.column(1), part.column(2)).packed()], schema=ARROW_BLOCKS())
        release_memory()

    size = F.transform("vector", F.abs)
    lead = F.when(F.size("vector") > 0, F.array_position(size, F.array_max(size)))
    placed = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vector", lead.alias("lead"), F.element_at("vector", lead.cast("int")).alias("_at"))
    order = ["label", "lead", (F.col("_at") > 0), "vec_id"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("vec_id").cast("long"), "label", "vector")
    return durable(placed.mapInArrow(lay_out, BLOCKS).withColumn("part", F.monotonically_increasing_id()), "blocks")


def ARROW_BLOCKS() -> pa.Schema:
    return pa.schema([("rows", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("columns", pa.binary())])


class Anchors:
    """A slice of anchors with what their scans have found so far.

    ``low`` and ``high`` are the limits of each anchor's windows; a window without an upper
    limit ranks positives. ``scores`` and ``found`` are the best rows of each window.
    """

    def __init__(self, ids, labels, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, same_label: bool, floor: np.ndarray | None = None):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low, self.high, self.keep, self.same_label = low, high, keep, same_label
        self.order = np.argsort(-np.abs(vectors), axis=1, kind="stable")
        self.floor = np.maximum(low, floor) if floor is not None else low
        self.scores = np.full((*low.shape, keep), LOWEST)
        self.found = np.zeros((*low.shape, keep), np.int64)

    def thresholds(self, i: int) -> np.ndarray:
        """A row of anchor ``i`` counts in a window only from this score on."""
        return np.maximum(self.floor[i], self.scores[i, :, -1])

    def scan(self, block: Block) -> None:
        d = min(self.vectors.shape[1], len(block.low))
        q = self.vectors[:, :d]
        greatest = np.abs(q).max(initial=0)
        if float(greatest) * float(max(-block.low.min(initial=0), block.high.max(initial=0))) * max(1, d) >= 2.0**55:
            raise ValueError("components are too large: scores beyond 2^55 are not supported")
        above, below = np.maximum(q, 0), np.minimum(q, 0)
        most = above @ block.high[:d] + below @ block.low[:d]
        least = above @ block.low[:d] + below @ block.high[:d]
        wanted = np.maximum(self.floor, self.scores[:, :, -1])
        reachable = ((most[:, None] >= wanted) & (least[:, None] <= self.high)).any(axis=1)
        labels = {x: block.labels == x for x in np.unique(block.labels).tolist()}
        for i in np.flatnonzero(reachable).tolist():
            same = labels.get(int(self.labels[i]))
            if self.same_label:
                if same is None:
                    continue
                rows = np.flatnonzero(same & (block.ids != self.ids[i]))
            else:
                rows = np.arange(len(block.ids)) if same is None else np.flatnonzero(~same)
            if len(rows):
                self._scan_one(i, block, rows, d)

    def _scan_one(self, i: int, block: Block, rows: np.ndarray, d: int) -> None:
        order = self.order[i]
        order = order[order < d]
        q = self.vectors[i, order]
        q = q[: np.count_nonzero(q)]  # zeros come last
        order = order[: len(q)]
        at_low, at_high = q * block.low[order], q * block.high[order]
        # What the columns from the j-th on can still add.
        can_add = np.append(np.cumsum(np.maximum(at_low, at_high)[::-1])[::-1], 0)
        must_add = np.append(np.cumsum(np.minimum(at_low, at_high)[::-1])[::-1], 0)
        score, done, step = np.zeros(len(rows), np.int64), 0, FIRST_STEP
        limits, highs = self.thresholds(i), self.high[i]
        while done < len(q):
            stop = min(len(q), done + step)
            read = block.columns[order[done:stop]]
            score += q[done:stop] @ (read if len(rows) == len(block.ids) else read[:, rows]).astype(np.int64)
            done, step = stop, step * 2
            most, least = score + can_add[done], score + must_add[done]
            limit = limits
            if self.same_label and len(rows) > self.keep:
                # As many rows as are kept are sure to reach this.
                limit = np.maximum(limits, np.partition(least, len(rows) - self.keep)[len(rows) - self.keep])
            alive = ((most[:, None] >= limit) & (least[:, None] <= highs)).any(axis=1)
            if not alive.all():
                rows, score = rows[alive], score[alive]
                if not len(rows):
                    return
        for w in range(len(limits)):
            inside = np.flatnonzero((score >= limits[w]) & (score <= highs[w]))
            if len(inside):
                all_scores = np.concatenate([self.scores[i, w], score[inside]])
                all_ids = np.concatenate([self.found[i, w], block.ids[rows[inside]]])
                best = np.lexsort((all_ids, -np.maximum(all_scores, LOWEST + 1)))[: self.keep]
                self.scores[i, w], self.found[i, w] = all_scores[best], all_ids[best]

    def table(self) -> pa.RecordBatch:
        i, w, k = np.nonzero(self.scores > LOWEST)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[i]), pa.array(w.astype(np.int32)), pa.array(self.found[i, w, k]), pa.array(self.scores[i, w, k])],
            names=["anchor_id", "window", "vec_id", "score"],
        )


FOUND = "anchor_id BIGINT, window INT, vec_id BIGINT, score BIGINT"


def _scanned(blocks: DataFrame, make, keep: int) -> DataFrame:
    """The best rows of each window over all blocks: each task's best ones, ranked together."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        anchors = make()
        for batch in batches:
            for row in batch.to_pylist():
                anchors.scan(Block.read(row))
        yield anchors.table()
        release_memory()

    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    found = blocks.drop("part").mapInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def _floors(found: DataFrame, ids: np.ndarray, windows: int, keep: int) -> np.ndarray:
    """The k-th best score of each window where there is one; at most as many rows as the slice has windows."""
    floors = np.full((len(ids), windows), LOWEST)
    table = found.where(F.col("rank") == keep).select("anchor_id", "window", "score").toArrow()
    if table.num_rows:
        floors[np.searchsorted(ids, table["anchor_id"].to_numpy()), table["window"].to_numpy()] = table["score"].to_numpy()
    return floors


def best_rows(blocks: DataFrame, ids, labels, vectors, low, high, keep: int, same_label: bool) -> DataFrame:
    """``(anchor_id, window, vec_id, score, rank)`` of one slice of anchors; ids ascend."""
    context = blocks.sparkSession.sparkContext

    def ranked(part: DataFrame, floor) -> DataFrame:
        sent = context.broadcast((ids, labels, vectors, low, high, keep, same_label, floor))
        return _scanned(part, lambda: Anchors(*sent.value), keep)

    seeds = ranked(blocks.where(F.pmod(F.xxhash64("part"), F.lit(SEED_SHARE)) == 0), None)
    return ranked(blocks, _floors(seeds, ids, low.shape[1], keep))


def anchor_slices(vectors: DataFrame, is_anchor) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and padded vectors of the anchors, at most about ``SLICE_ANCHORS`` at a time, ids ascending."""
    anchors = vectors.where(is_anchor)
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    slices = max(1, math.ceil(size.n / SLICE_ANCHORS), math.ceil(size.n * (size.d or 1) / SLICE_CELLS))
    for k in range(slices if size.n else 0):
        part = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == k).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
        table = part.toArrow().combine_chunks().sort_by("vec_id")
        if table.num_rows:
            block = Block.of(*(table[name].combine_chunks() for name in ("vec_id", "label", "vector")))
            yield block.ids, block.labels, np.ascontiguousarray(block.columns.T)


def mine(vectors: DataFrame, is_anchor, windows: Windows = Windows()) -> DataFrame:
    """For each anchor and each of its positives, the best negatives inside the positive's window.

    ``vectors`` holds ``(vec_id, label, vector)`` with whole numbers as components, as from
    ``usable``; ``is_anchor`` is a condition on them.
    """
    spark = vectors.sparkSession
    vectors = durable(vectors, "vectors")
    blocks = column_blocks(vectors)
    result = spark.createDataFrame([], "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT")
    for ids, labels, values in anchor_slices(vectors, is_anchor):
        everything = np.full((len(ids), 1), LOWEST), np.full((len(ids), 1), np.iinfo(np.int64).max)
        positives = durable(best_rows(blocks, ids, labels, values, *everything, windows.positives, True), "positives")
        # At most as many rows as the slice has anchors, times the positives of each.
        found = positives.toArrow()
        place, window = np.searchsorted(ids, found["anchor_id"].to_numpy()), found["rank"].to_numpy() - 1
        score = found["score"].to_numpy()
        # Limits that no score meets stand for windows that don't exist.
        low, high = np.full((len(ids), windows.positives), np.iinfo(np.int64).max), np.full((len(ids), windows.positives), LOWEST)
        low[place, window] = -(-windows.low * score // 100)
        high[place, window] = windows.high * score // 100
        negatives = best_rows(blocks, ids, labels, values, low, high, windows.negatives, False)
        part = negatives.select("anchor_id", (F.col("window") + 1).alias("_window"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = positives.select("anchor_id", F.col("rank").alias("_window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        result = result.unionByName(durable(part.join(named, ["anchor_id", "_window"]).drop("_window").select(*result.columns), "negatives"))
    return result


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth row; every seventh row takes the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(embeddings, label=label), F.col("vec_id") % 100 == 0)
