"""The pipeline's stages on a small corpus: each against a plain model of its own input."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from roadloom.durable import durable
from roadloom.llm import decontamination, line_quality, toxicity
from tests.llm.test_near_duplicates import model

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(durable(stage(spark, results[-1], FOLDER), "stage"))
    return [r.collect() for r in results], results


def rows(collected):
    return sorted(map(tuple, collected), key=repr)


def test_columns_and_order(stages):
    collected, frames = stages
    assert len(corpus_pipeline.STAGES) == 5
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    for before, after in zip(collected[:-2], collected[1:-1]):
        assert set(rows(after)) <= set(rows(before))


def test_classifiers_decide(spark, stages):
    (docs, harmless, good, *_), frames = stages
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.with_scores(frames[0], toxicity.learn(frames[0], labels), keep=("doc_id",)).collect()}
    assert rows(harmless) == rows(r for r in docs if scores[r.doc_id] < 0.5)
    scores = {r.doc_id: r.score for r in line_quality.with_scores(frames[1], line_quality.learn(frames[1], labels), "text", ("doc_id",)).collect()}
    assert rows(good) == rows(r for r in harmless if scores[r.doc_id] >= 0.7)


def test_one_of_each_group(stages):
    (_, _, good, single, *_), _ = stages
    groups = {c for _, c, *_ in model([(r.doc_id, r.text) for r in good])}
    assert {r.doc_id for r in single} == groups and len(single) == len(groups)


def test_clean_documents_stay(spark, stages):
    (*_, single, clean, _), _ = stages
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {r[0] for r in decontamination.brute_force([(r.doc_id, r.text) for r in single], items) if r[-1]}
    assert rows(clean) == rows(r for r in single if r.doc_id not in dirty)


def test_tokens(stages):
    (*_, clean, tokens), _ = stages
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in clean:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in tokens} == want and len(tokens) == len(clean)


def test_run_gives_the_last_stage(spark, stages):
    collected, _ = stages
    assert rows(corpus_pipeline.run(spark, FOLDER).collect()) == rows(collected[-1])
