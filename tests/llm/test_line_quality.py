"""Marginals against summing over all labellings, and accuracy on held-out labels."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from roadloom.llm import line_quality as q

FOLDER = "/root/testdata/sf0.01"


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(1)
    offsets = np.array([0, 4, 5, 11, 12])
    emissions, transitions = rng.normal(size=(12, 2)) * 2, rng.normal(size=(2, 2))
    single, pair, total, linked = q.marginals(emissions, transitions, offsets)
    for chain, (a, b) in enumerate(zip(offsets, offsets[1:])):
        weight = np.zeros((b - a, 2))
        links, z = np.zeros((b - a, 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(emissions[a + i, v] for i, v in enumerate(y)) + sum(transitions[u, v] for u, v in zip(y, y[1:])))
            z += p
            for i, v in enumerate(y):
                weight[i, v] += p
                if i + 1 < b - a:
                    links[i, v, y[i + 1]] += p
        assert np.allclose(single[a:b], weight / z) and np.isclose(total[chain], np.log(z))
        mine = (linked >= a) & (linked < b)
        assert np.allclose(pair[mine], (links / z)[: b - a - 1])


def test_lines_follow_the_texts():
    texts = ["a\nbb\n\nccc", None, "", "\n", "one", "x x x x\r\ny"]
    lines = q.lines_of(pa.array(texts))
    sizes = [[len(part) for part in (t or "").split("\n")] for t in texts]
    assert lines.sizes.tolist() == sum(sizes, []) and np.diff(lines.offsets).tolist() == [len(s) for s in sizes]
    # What a text's lines look like depends on nothing around the text.
    for i, t in enumerate(texts):
        alone = q.lines_of(pa.array([t], pa.string()))
        assert np.allclose(alone.features, lines.features[lines.offsets[i] : lines.offsets[i + 1]])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in q.report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    truth = {r.doc_id: r.quality for r in labels.collect() if got[r.doc_id].held_out}
    assert sum(got[i].predicted == t for i, t in truth.items()) / len(truth) > 0.95


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = [(1, None), (None, ""), (2, "x\n" * 30000), (2, "x\n" * 30000), (3, "word " * 50000), (4, "\n\n")]
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in odd], "doc_id long, text string, row string, score int")
    scored = q.with_scores(frame, q.learn(docs, labels), "text", ("doc_id",)).collect()
    assert len(scored) == len(odd) and all(0 <= r.score <= 1 for r in scored)
    kept = q.keep_good(frame, labels.limit(0))
    assert kept.columns == frame.columns and kept.count() == len(odd)
    assert q.report(frame.limit(0), labels).count() == 0
    strange = spark.createDataFrame([(2, 1), (2, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert {r.score for r in q.report(frame, strange).collect()} == {1.0}


def test_learns_from_whole_documents(spark):
    texts = [f"A good line of text, number {i}.\n" * 250 + ("$$ ## BUY 1234 !!\n" * 60 if i % 2 else "") for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 = 0 AS INT) AS quality")
    rows = docs.join(labels, "doc_id").selectExpr("doc_id", "text", "quality", "xxhash64(doc_id) AS place").orderBy("place").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % q.HELD_OUT != q.HELD_OUT_BUCKET]
    # No document is taken in part: the bound is reached inside the eleventh.
    for bound, taken in ((q.MAX_LINES, rows), (sum(r.text.count("\n") + 1 for r in rows[:11]) - 1, rows[:10])):
        lines = q.lines_of(pa.array([r.text for r in taken]))
        lines = q.Lines(lines.features.astype(np.float32), lines.sizes.astype(np.float32), lines.offsets)
        want, got = q.fit(lines, np.array([r.quality for r in taken])), q.learn(docs, labels, max_lines=bound)
        assert np.allclose(got.weights, want.weights) and np.allclose(got.curve, want.curve) and np.allclose(got.transitions, want.transitions)


def test_scores_equal_a_plain_loop(spark, tables):
    """The report's scores from each text alone, its chain summed step by step."""
    docs, labels = tables
    field = q.learn(docs, labels)
    texts = [(i, f"Line one of {i}.\nAnother line, a bit longer.\n" + "$$ BUY ##\n" * (i % 4)) for i in range(60)] + [(3, None), (4, ""), (5, "twice"), (5, "twice"), (6, "x " * 700_000)]
    got = {(r.doc_id, r.score) for r in q.with_scores(spark.createDataFrame(texts, "doc_id long, text string"), field, "text", ("doc_id",)).collect()}
    assert len({s for i, s in got if i == 5}) <= 2

    def plain(text):
        lines = q.lines_of(pa.array([text], pa.string()))
        emission = lines.features.astype(float) @ field.weights
        e, t = [np.array([0.0, x]) for x in emission], field.transitions
        forward = [e[0]]
        for x in e[1:]:
            forward.append(x + np.log(np.exp(forward[-1][:, None] + t).sum(axis=0)))
        backward = [np.zeros(2)]
        for x in e[:0:-1]:
            backward.insert(0, np.log(np.exp(t + (x + backward[0])[None]).sum(axis=1)))
        good = []
        for f, b in zip(forward, backward):
            p = np.exp(f + b - np.logaddexp(*(f + b)))
            good.append(p[q.GOOD])
        total = lines.sizes.sum()
        mean = (np.array(good) * lines.sizes).sum() / total if total else 1.0
        a, b = field.curve
        return 1 / (1 + np.exp(-np.clip(a * mean + b, -35, 35)))

    for i, text in texts:
        want = plain(text)
        assert any(j == i and abs(s - want) < 1e-6 for j, s in got), (i, want)
