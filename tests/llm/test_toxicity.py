"""The learner against a plain loop, and accuracy on held-out labels."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from roadloom.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


def plain_fit(examples, labels):
    """The same updates, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        s, l1 = z.get(i, 0.0), 0 if i == "bias" else toxicity.L1
        return 0.0 if abs(s) <= l1 else -(s - np.sign(s) * l1) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for features, label in zip(examples, labels):
            own = [*features, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in own:
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_fit_equals_the_plain_loop():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 200)
    examples = [np.unique(np.append(rng.integers(0, 40, 6), 50 + label * rng.integers(0, 2))).astype(np.uint32) for label in labels]
    times = {i: sum(i in e for e in examples) for i in range(60)}
    offsets = np.cumsum([0, *map(len, examples)])
    hashes, weights, bias = toxicity.fit(np.concatenate(examples), offsets, labels.astype(float))
    want = plain_fit([[i for i in e.tolist() if times[i] >= toxicity.MIN_EXAMPLES] for e in examples], labels)
    got = dict(zip(hashes.tolist(), weights)) | {"bias": bias}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect() if got[r.doc_id].held_out}
    right = sum(got[i].predicted == t for i, t in truth.items())
    assert right / len(truth) > 0.9


def test_odd_rows(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    odd = [(1, None), (None, ""), (2, "idiot"), (2, "idiot"), (3, "word " * 50000), (4, "漢字")]
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in odd], "doc_id long, text string, row string, score int")
    scored = toxicity.with_scores(frame, model, keep=("doc_id",)).collect()
    assert len(scored) == len(odd) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.keep_harmless(frame, labels.limit(0)).columns == frame.columns
    assert toxicity.keep_harmless(frame, labels.limit(0)).count() == len(odd)
    assert toxicity.report(frame.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.report(frame, labels.limit(0)).collect()} == {0.0}
    strange = spark.createDataFrame([(2, 1), (2, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.report(frame, strange).count() == len(odd)


def test_model_counts_a_feature_once():
    text = pa.array(["bad bad bad", "bad"])
    from roadloom.llm.words import word_blocks

    hashes, where = toxicity.feature_hashes(next(iter(word_blocks(text))))
    alone = np.unique(hashes[where == 1])
    a, b = toxicity.Model(alone, np.ones(len(alone)), 0.0).scores(text)
    assert a == b


def test_learns_from_all_of_16000_examples(spark):
    rng = np.random.default_rng(7)
    words = [[f"w{k}" for k in rng.integers(0, 300, 6)] + (["nasty"] if i % 7 == 0 else []) for i in range(14_000)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 7 = 0 OR doc_id % 11 = 0 AS INT) AS toxic")
    rows = docs.join(labels, "doc_id").selectExpr("doc_id", "text", "toxic", "xxhash64(doc_id) AS place").orderBy("place").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % toxicity.HELD_OUT]
    assert 10_000 < len(rows) < 16_000
    from roadloom.llm.words import word_blocks

    examples = []
    for block in word_blocks(pa.array([r.text for r in rows])):
        hashes, where = toxicity.feature_hashes(block)
        examples += [np.unique(hashes[where == i]) for i in range(block.texts)]
    hashes, weights, bias = toxicity.fit(np.concatenate(examples), np.cumsum([0, *map(len, examples)]), np.array([float(r.toxic) for r in rows]))
    model = toxicity.learn(docs, labels)
    assert len(hashes) and np.array_equal(model.hashes, hashes) and np.allclose(model.weights, weights) and np.isclose(model.bias, bias)


def test_scores_equal_a_plain_loop(spark, tables):
    """The report's scores from each text alone, word by word; a text seen twice and one over several batches."""
    from roadloom.llm.words import word_blocks

    docs, labels = tables
    model = toxicity.learn(docs, labels)
    weights = dict(zip(model.hashes.tolist(), model.weights))
    own = [r.text for r in docs.limit(40).collect()]
    texts = [*enumerate(own), (100, None), (101, ""), (102, own[0]), (102, own[0]), (103, " ".join(t or "" for t in own) * 12)]
    scored = toxicity.with_scores(spark.createDataFrame(texts, "doc_id long, text string"), model, keep=("doc_id",)).collect()
    got = sorted((r.doc_id, r.score) for r in scored)
    want = []
    for i, text in texts:
        hashes = {int(h) for block in word_blocks(pa.array([text], pa.string())) for h in toxicity.feature_hashes(block)[0]}
        margin = model.bias + sum(weights.get(h, 0.0) for h in hashes)
        want.append((i, 1 / (1 + np.exp(-np.clip(margin, -35, 35)))))
    assert len(got) == len(want) and all(a == b and abs(x - y) < 1e-9 for (a, x), (b, y) in zip(got, sorted(want)))


def test_the_sample_is_bounded_by_its_features(spark):
    """Documents with the lowest hashes, whole, until their features are as many as the bound."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(50)) + (" vile" if i % 2 else " kind")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    few, all_ = toxicity.learn(docs, labels, max_features=3000), toxicity.learn(docs, labels)
    assert few.bias is not None and few.bias != all_.bias
    assert toxicity.learn(docs, labels, max_features=10).bias is None
