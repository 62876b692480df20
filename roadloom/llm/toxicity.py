"""Toxicity: sparse logistic regression over hashed word n-grams, learned by FTRL-proximal.

Features of a text are the hashes of its words, of its pairs of neighbouring words and of
its pairs of words with one between them; each counts once per text. Follow-the-
regularised-leader keeps two numbers per coordinate, its sum of adjusted gradients and its
sum of squared gradients. The latter sets the coordinate's own learning rate, and L1 keeps
every coordinate at zero whose sum stays small, so what is left is a short list of
(hash, weight) that all tasks get.

FTRL sees one example at a time. It is fitted on a bounded sample of labelled documents
(``MAX_EXAMPLES`` whole documents, fewer where they have more than ``MAX_FEATURES`` features
together: those with the lowest hashes of their ids); features are made where the documents are, the pass over them is one
task's work. Coordinates get room only when ``MIN_EXAMPLES`` examples have them; these are
counted range by range of the hashes, and only they are sent to the task that fits.

A null or empty text has no features and scores as the bias says. Equal texts score
equally, repeated rows each get a row. A null id is never held out nor learned from. Columns
other than the named ones are kept or not looked at, as the caller asks. An empty table gives
no rows; without any labelled example every score is 0.
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
from roadloom.llm.words import WordBlock, hash_runs, mix, word_blocks

#: Examples that are learned from, at most, and their features together: some 400 MB where they are fitted.
MAX_EXAMPLES, MAX_FEATURES = 16_000, 40_000_000
MIN_EXAMPLES = 5
HELD_OUT = 5
#: Ranges of hashes that are counted apart.
RANGES = 256

ALPHA, BETA, L1, L2, PASSES = 6.0, 1.0, 4.0, 0.0, 5


def feature_hashes(block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
    """The features of a block's texts as 32-bit hashes, with the text of each; repeats included."""
    words, text = block.hashes, np.repeat(np.arange(block.texts), block.counts)
    hashes, texts = [mix(words + np.uint64(1))], [text]
    if len(words) > 1:
        inside = text[:-1] == text[1:]
        hashes.append(hash_runs(words, 2)[inside])
        texts.append(text[1:][inside])
    if len(words) > 2:
        inside = text[:-2] == text[2:]
        skipped = mix(words[:-2] * np.uint64(0xA24BAED4963EE407) + words[2:] * np.uint64(0x9FB21C651E98DF25))
        hashes.append(skipped[inside])
        texts.append(text[2:][inside])
    return (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), np.concatenate(texts)


def roomy_hashes(flat: np.ndarray) -> np.ndarray:
    """The hashes that at least ``MIN_EXAMPLES`` examples have, in order; ``flat`` is sorted in place."""
    flat.sort()
    first = np.flatnonzero(flat[MIN_EXAMPLES - 1 :] == flat[: len(flat) - MIN_EXAMPLES + 1]) if len(flat) >= MIN_EXAMPLES else np.zeros(0, int)
    return np.unique(flat[first])


def fit(flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes, their weights and the bias, from examples in the order given.

    Example ``i`` has the distinct hashes ``flat[offsets[i]:offsets[i + 1]]``.
    """
    roomy = roomy_hashes(flat.copy())
    examples = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        at = np.minimum(np.searchsorted(roomy, flat[a:b]), len(roomy) - 1) if len(roomy) else np.zeros(0, int)
        examples.append(np.append(at[roomy[at] == flat[a:b]] if len(roomy) else at, len(roomy)).astype(np.int32))
    z, n = np.zeros(len(roomy) + 1), np.zeros(len(roomy) + 1)
    penalty = np.full(len(roomy) + 1, L1)
    penalty[-1] = 0  # the bias

    def weights(i):
        pull = np.maximum(np.abs(z[i]) - penalty[i], 0)
        return -np.sign(z[i]) * pull / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(PASSES):
        for i, label in zip(examples, labels):
            w = weights(i)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            squared = gradient * gradient
            z[i] += gradient - (np.sqrt(n[i] + squared) - np.sqrt(n[i])) / ALPHA * w
            n[i] += squared
    found = weights(np.arange(len(z)))
    kept = np.flatnonzero(found[:-1])
    return roomy[kept], found[kept], float(found[-1])


@dataclass
class Model:
    """Sorted hashes with weights; ``heads`` tells quickly which hashes have none."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float | None

    def __post_init__(self):
        self.heads = np.zeros(1 << 16, bool)
        self.heads[self.hashes >> np.uint32(16)] = True

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.bias is None:
            return out
        for block in word_blocks(column):
            hashes, text = feature_hashes(block)
            likely = np.flatnonzero(self.heads[hashes >> np.uint32(16)])
            hashes, text = hashes[likely], text[likely]
            margin = np.full(block.texts, self.bias)
            if len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                known = self.hashes[place] == hashes
                once = np.unique(text[known] * len(self.hashes) + place[known])
                margin += np.bincount(once // len(self.hashes), self.weights[once % len(self.hashes)], block.texts)
            out[block.first : block.first + block.texts] = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = MAX_EXAMPLES, max_features: int = MAX_FEATURES) -> Model:
    """The model of a bounded sample of the labelled documents that are not held out."""
    ship_package(docs.sparkSession)
    examples = sample(docs, labels, label, bucket("doc_id", HELD_OUT) != 0, max_examples)

    def featured(batches):
        for batch in batches:
            features = []
            for block in word_blocks(batch.column("text")):
                hashes, text = feature_hashes(block)
                pairs = np.unique(text.astype(np.uint64) << np.uint64(32) | hashes)
                cuts = np.searchsorted(pairs >> np.uint64(32), np.arange(1, block.texts).astype(np.uint64))
                features += [part.astype(np.uint32).astype(np.int32) for part in np.split(pairs, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(features, pa.list_(pa.int32()))], names=["place", "label", "features"])

    def in_ranges(batches):
        for batch in batches:
            flat = np.sort(batch.column("features").flatten().to_numpy().view(np.uint32))
            cuts = np.searchsorted(flat, np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 32) // RANGES))
            pieces = [piece.tobytes() for piece in np.split(flat, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(pieces, pa.binary())], names=["range", "hashes"])
        release_memory()

    def counted(group: pa.Table) -> pa.Table:
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("hashes")])
        return pa.table({"hash": roomy_hashes(flat).view(np.int32)})

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        features = group.column("features").combine_chunks()
        flat = features.flatten().to_numpy().view(np.uint32)
        offsets = features.offsets.to_numpy() - features.offsets[0].as_py()
        hashes, weights, bias = fit(flat, offsets, group.column("label").to_numpy().astype(float))
        release_memory()
        return pa.table({"hash": np.append(hashes.astype(np.int64), -1), "weight": np.append(weights, bias)})

    with scratch(docs.sparkSession):
        described = durable(examples.mapInArrow(featured, "place BIGINT, label INT, features ARRAY<INT>"), "features").where(F.size("features") <= max_features)
        # At most max_examples narrow rows.
        sizes = described.select("place", F.size("features").alias("n")).toArrow().sort_by("place")
        taken = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy()) <= max_features)
        if 0 < len(taken) < sizes.num_rows:
            described = described.where(F.col("place") <= sizes.column("place")[int(taken[-1])].as_py())
        counts = described.select("features").mapInArrow(in_ranges, "range INT, hashes BINARY").groupBy("range").applyInArrow(counted, "hash INT")
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(counts.toArrow().column("hash").to_numpy().view(np.uint32)))

        def with_room(batches):
            for batch in batches:
                features = batch.column("features")
                flat = features.flatten().to_numpy()
                known = np.isin(flat.view(np.uint32), sent.value)
                offsets = np.append(0, np.cumsum(known))[features.offsets.to_numpy() - features.offsets[0].as_py()]
                left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[known], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), left], names=["place", "label", "features"])
            release_memory()

        rows = (
            described.mapInArrow(with_room, described.schema)
            .withColumn("every", F.lit(True)).groupBy("every").applyInArrow(fitted, "hash BIGINT, weight DOUBLE").toArrow()
        )
    hashes, weights = rows.column("hash").to_numpy(), rows.column("weight").to_numpy()
    bias = weights[hashes < 0]
    order = np.argsort(hashes[hashes >= 0])
    return Model(hashes[hashes >= 0][order].astype(np.uint32), weights[hashes >= 0][order], float(bias[0]) if len(bias) else None)


def with_scores(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None, score: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if not given) with the score of each text."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c != score]
    place = kept.index(text) if text in kept else len(kept)
    given = docs.select(*kept) if text in kept else docs.select(*kept, text)
    schema = docs.select(*kept, F.lit(0.0).alias(score)).schema

    def run(batches):
        for part in parts(batches, place):
            scores = pa.array(sent.value.scores(part.column(place)), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], scores], names=[*kept, score])

    return given.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: whether it is held out, its score and what that predicts."""
    scored = with_scores(docs, learn(docs, labels), keep=("doc_id",))
    return scored.select(
        "doc_id", (bucket("doc_id", HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted to be toxic, columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return keep_rows(docs, "text", lambda texts: sent.value.scores(texts) < 0.5)
