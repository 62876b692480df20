"""Document quality from lines: a linear-chain conditional random field labels each line good or bad.

A line is described by shares of its characters, by how its words repeat and by the same
figures of the lines next to it. The chain has two labels; forward and backward passes
give every line its marginal probability of being good, and a document's score is the
mean of these marginals weighted by the lines' lengths, put through a fitted logistic
curve.

Only documents are labelled. All lines of a good document are good; of a bad one, at
least the worst line is bad, and which others are is settled by fitting the field and
relabelling a few times (``ROUNDS``), starting from "all bad". Fitting takes a bounded
sample of whole labelled documents: at most ``MAX_EXAMPLES`` that have at most ``MAX_LINES``
lines together, those with the lowest hashes. Documents that alone have more lines than that
are not learned from; scoring reads every line of every text.

A text without lines that hold anything scores like one empty good line: it shows nothing
bad. Null counts as empty. Equal texts score equally, repeated rows each get a row. A null
id is never held out nor learned from. Of a kept column that is named ``score`` only the
result stays; other columns are not looked at. An empty table gives no rows; without labelled
examples of both kinds every score is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.durable import durable, scratch
from roadloom.llm.labelled import bucket, sample
from roadloom.llm.rows import keep_rows, parts, release_memory
from roadloom.llm.shipping import ship_package
from roadloom.llm.words import text_bytes, text_slices, word_blocks

MAX_EXAMPLES = 8_000
#: Fitting so many lines takes 0.8 GB beside the 0.2 GB in which they arrive.
MAX_LINES = 1_000_000
HELD_OUT = 4
HELD_OUT_BUCKET = 2
GOOD_SCORE = 0.7

ROUNDS, STEPS, RATE, RIDGE = 3, 80, 0.1, 1e-3
BAD, GOOD = 0, 1


@dataclass
class Lines:
    """Lines of some texts: features, lengths, and the first line of each text (one more at the end)."""

    features: np.ndarray
    sizes: np.ndarray
    offsets: np.ndarray


def _classes() -> dict[str, np.ndarray]:
    table = {name: np.zeros(256, np.int32) for name in ("upper", "digit", "space", "mark", "odd", "other")}
    table["upper"][65:91] = 1
    table["digit"][48:58] = 1
    table["space"][[9, 13, 32]] = 1
    table["mark"][[ord(c) for c in ".,;:?'\"()-"]] = 1
    table["odd"][[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 1
    table["other"][128:] = 1
    return table


_CLASSES = _classes()


def lines_of(column: pa.Array) -> Lines:
    """The lines of a block of texts; every text has at least one."""
    data, offsets = text_bytes(column)
    texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    # Each text starts a line, each line feed starts another.
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(texts), text_of_break])
    order = np.lexsort((np.arange(len(starts)), text))
    starts, text = starts[order], text[order]
    first = np.searchsorted(text, np.arange(texts + 1))
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:] - 1
    stops[first[1:] - 1] = offsets[1:]
    sizes = stops - starts
    own = _line_features(data, starts, stops, sizes)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edge = np.zeros((len(starts), 2), np.float32)
    edge[first[:-1], 0] = edge[first[1:] - 1, 1] = 1
    ones = np.ones((len(starts), 1), np.float32)
    return Lines(np.hstack([ones, own, before, after, edge]), sizes, first)


def _line_features(data, starts, stops, sizes) -> np.ndarray:
    length = np.maximum(sizes, 1)
    shares = []
    for table in _CLASSES.values():
        running = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=running[1:])
        shares.append((running[stops] - running[starts]) / length)
    # Lines as texts: line feeds are no word characters.
    lines = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    ) if len(starts) else pa.array([], pa.large_string())
    words, repeats, neighbours, mean_size = (np.zeros(len(starts)) for _ in range(4))
    if len(starts):
        for block in word_blocks(lines):
            rows = slice(block.first, block.first + block.texts)
            count = np.maximum(block.counts, 1)
            line = np.repeat(np.arange(block.texts), block.counts)
            words[rows] = block.counts
            size = np.concatenate([[0], np.cumsum(block.ends - block.starts)])
            mean_size[rows] = (size[block.offsets[1:]] - size[block.offsets[:-1]]) / count
            same = (block.hashes[1:] == block.hashes[:-1]) & (line[1:] == line[:-1])
            neighbours[rows] = np.bincount(line[1:][same], minlength=block.texts) / count
            distinct = np.unique(block.hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            repeats[rows] = 1 - np.bincount(line[distinct], minlength=block.texts) / count
    tiny = sizes < 20
    columns = [
        *shares, *(share > 0.05 for share in (shares[4], shares[0] - 0.25)), np.log1p(sizes) / 8, np.log1p(words) / 6,
        np.minimum(mean_size, 30) / 15, repeats, neighbours, neighbours > 0.3, tiny, sizes == 0,
    ]
    return np.column_stack(columns).astype(np.float32)


def _positions(offsets: np.ndarray):
    """Line numbers by their place in the chain: for each place, the lines there, chains with most lines first."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    counts, firsts = counts[order], offsets[:-1][order]
    for k in range(int(counts[0]) if len(counts) else 0):
        yield firsts[: np.searchsorted(-counts, -k, "left")] + k


def _softmax_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def marginals(emissions: np.ndarray, transitions: np.ndarray, offsets: np.ndarray):
    """P(label) of each line, P(label, next label) of each line that has a next one, and log Z of each chain."""
    forward, backward = emissions.copy(), np.zeros_like(emissions)
    places = list(_positions(offsets))
    for lines in places[1:]:
        forward[lines] += _softmax_sum(forward[lines - 1][:, None, :] + transitions.T[None])
    for lines in places[:0:-1]:
        backward[lines - 1] = _softmax_sum((emissions[lines] + backward[lines])[:, None, :] + transitions[None])
    total = _softmax_sum(forward + backward)
    single = np.exp(forward + backward - total[:, None])
    linked = np.ones(len(emissions), bool)
    linked[offsets[1:] - 1] = False
    i = np.flatnonzero(linked)
    pair = forward[i][:, :, None] + transitions[None] + (emissions[i + 1] + backward[i + 1])[:, None, :] - total[i][:, None, None]
    return single, np.exp(pair), total[offsets[:-1]], i


def weighted_means(good: np.ndarray, lines: Lines) -> np.ndarray:
    """The marginals' mean for each text, weighted by length; of a text without characters, 1."""
    sizes = lines.sizes.astype(float)
    weighted = np.concatenate([[0], np.cumsum(good * sizes)])
    length = np.concatenate([[0], np.cumsum(sizes)])
    total = length[lines.offsets[1:]] - length[lines.offsets[:-1]]
    share = (weighted[lines.offsets[1:]] - weighted[lines.offsets[:-1]]) / np.maximum(total, 1)
    return np.where(total > 0, share, 1.0)


@dataclass
class Field:
    """Weights of the features for "good" against "bad", the transitions, and the curve over the mean."""

    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float]
    fitted: bool = True

    def good(self, lines: Lines) -> np.ndarray:
        emissions = np.zeros((len(lines.sizes), 2))
        emissions[:, GOOD] = lines.features @ self.weights
        return marginals(emissions, self.transitions, lines.offsets)[0][:, GOOD]

    def means(self, lines: Lines) -> np.ndarray:
        return weighted_means(self.good(lines), lines)

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.ones(len(column))
        a, b = self.curve
        parts = [self.means(lines_of(column.slice(first, count))) for first, count in text_slices(column)]
        return 1 / (1 + np.exp(-np.clip(a * np.concatenate([*parts, np.zeros(0)]) + b, -35, 35)))


def _scaled(features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One copy of the features with mean 0 and deviation 1, in 32 bits, and both; the first column stays."""
    n, blocks = max(1, len(features)), range(0, len(features), 1 << 14)
    middle = sum((features[i : i + (1 << 14)].sum(axis=0, dtype=float) for i in blocks), np.zeros(features.shape[1])) / n
    squares = sum((np.square(features[i : i + (1 << 14)] - middle).sum(axis=0) for i in blocks), np.zeros(features.shape[1]))
    spread = np.sqrt(squares / n)
    middle[0], spread[spread == 0] = 0, 1
    scaled = features.astype(np.float32)
    scaled -= middle.astype(np.float32)
    scaled /= spread.astype(np.float32)
    return scaled, middle, spread


def _good(features: np.ndarray, weights: np.ndarray, transitions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    emissions = np.zeros((len(features), 2))
    emissions[:, GOOD] = features @ weights.astype(np.float32)
    return marginals(emissions, transitions, offsets)[0][:, GOOD]


def _ascend(features, labels, offsets, weights, transitions):
    """Steps along the smoothed gradient of the labels' log likelihood, by its smoothed size (Adam)."""
    n = len(labels)
    observed = (features.T @ (labels == GOOD).astype(np.float32)).astype(float)
    linked = np.ones(n, bool)
    linked[offsets[1:] - 1] = False
    i = np.flatnonzero(linked)
    counted = np.bincount(labels[i] * 2 + labels[i + 1], minlength=4).reshape(2, 2)
    slope, square = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, STEPS + 1):
        emissions = np.zeros((n, 2))
        emissions[:, GOOD] = features @ weights.astype(np.float32)
        single, pair, _, _ = marginals(emissions, transitions, offsets)
        gradient = np.concatenate([observed - features.T @ single[:, GOOD].astype(np.float32), (counted - pair.sum(axis=0)).ravel()]) / n
        gradient -= RIDGE * np.concatenate([weights, transitions.ravel()])
        slope, square = 0.9 * slope + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
        change = RATE * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        weights += change[:-4]
        transitions += change[-4:].reshape(2, 2)


def fit(lines: Lines, labels: np.ndarray) -> Field:
    """The field of labelled documents."""
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(lines.features.shape[1]), np.zeros((2, 2)), (0.0, 0.0), fitted=False)
    document = np.repeat(np.arange(len(labels)), np.diff(lines.offsets))
    line_labels = labels[document].astype(int)
    # Fitted on features of mean 0 and deviation 1; the result is for the features as they are.
    features, middle, spread = _scaled(lines.features)
    scaled = np.zeros(features.shape[1])
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)), (1.0, 0.0))
    for _ in range(ROUNDS):
        _ascend(features, line_labels, lines.offsets, scaled, field.transitions)
        field.weights = scaled / spread
        field.weights[0] -= (scaled * middle / spread)[1:].sum()
        good = _good(features, scaled, field.transitions, lines.offsets)
        line_labels = np.where(labels[document] == GOOD, GOOD, (good > 0.5).astype(int))
        worst = np.lexsort((good, document))[lines.offsets[:-1]]
        line_labels[worst[labels == BAD]] = BAD
    # A logistic curve over the mean, fitted so that both kinds weigh the same.
    x, y = weighted_means(_good(features, scaled, field.transitions, lines.offsets), lines), labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        curvature, error = weight * p * (1 - p) + 1e-9, weight * (y - p)
        design = np.column_stack([x, np.ones_like(x)])
        step = np.linalg.solve(design.T @ (design * curvature[:, None]) + 1e-3 * np.eye(2), design.T @ error - 1e-3 * np.array([a, b]))
        a, b = np.array([a, b]) + np.clip(step, -2, 2)
    return Field(field.weights, field.transitions, (float(a), float(b)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_examples: int = MAX_EXAMPLES, max_lines: int = MAX_LINES) -> Field:
    """The field of a bounded sample of the labelled documents that are not held out, each whole."""
    ship_package(docs.sparkSession)
    examples = sample(docs, labels, label, bucket("doc_id", HELD_OUT) != HELD_OUT_BUCKET, max_examples)

    def described(batches):
        for batch in batches:
            lines = lines_of(batch.column("text"))
            features = []
            for first, last in zip(lines.offsets[:-1], lines.offsets[1:]):
                features.append(np.column_stack([lines.features[first:last], lines.sizes[first:last]]).astype(np.float32).ravel())
            counts = pa.array(np.diff(lines.offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), counts, pa.array(features, pa.list_(pa.float32()))], names=["place", "label", "lines", "features"])

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        width = lines_of(pa.array([""])).features.shape[1] + 1
        parts = [row.values.to_numpy(zero_copy_only=False).reshape(-1, width) for row in group.column("features")]
        stacked = np.concatenate(parts)
        lines = Lines(stacked[:, :-1], stacked[:, -1], np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        field = fit(lines, group.column("label").to_numpy().astype(int))
        release_memory()
        return pa.table({"value": np.concatenate([[field.fitted], field.curve, field.transitions.ravel(), field.weights])})

    with scratch(docs.sparkSession):
        fitting = durable(examples.mapInArrow(described, "place BIGINT, label INT, lines BIGINT, features ARRAY<FLOAT>"), "lines").where(F.col("lines") <= max_lines)
        counts = fitting.select("place", "lines").toArrow().sort_by("place")
        taken = np.flatnonzero(np.cumsum(counts.column("lines").to_numpy()) <= max_lines)
        if len(taken):
            fitting = fitting.where(F.col("place") <= counts.column("place")[int(taken[-1])].as_py())
        values = (
            fitting.select("place", "label", "features")
            .withColumn("every", F.lit(True)).groupBy("every").applyInArrow(fitted, "value DOUBLE").toArrow().column("value").to_numpy()
        )
    if not len(values):
        return Field(np.zeros(1), np.zeros((2, 2)), (0.0, 0.0), fitted=False)
    return Field(values[7:], values[3:7].reshape(2, 2), (values[1], values[2]), bool(values[0]))


def with_scores(docs: DataFrame, field: Field, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the quality ``score`` of each text."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(field)
    keep = tuple(name for name in keep if name != "score")
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches):
        for part in parts(batches, len(keep)):
            scores = pa.array(sent.value.scores(part.column(len(keep))), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], scores], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: whether it is held out, its score and what that predicts."""
    return with_scores(docs, learn(docs, labels), "text", ("doc_id",)).select(
        "doc_id", (bucket("doc_id", HELD_OUT) == HELD_OUT_BUCKET).alias("held_out"), "score",
        (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score falls short, columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return keep_rows(docs, "text", lambda texts: sent.value.scores(texts) >= GOOD_SCORE)
