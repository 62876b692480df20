"""Ranked search against a plain loop over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np

from roadloom.llm import ranked_search as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def model(docs, items, best=10):
    vectors = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    documents, words = sum(n > 0 for *_, n in vectors), sum(n for *_, n in vectors)
    frequency = Counter(t for _, c, _ in vectors for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in queries.items():
        found = []
        for doc_id, counts, n in vectors:
            score = 0
            for t in wanted & counts.keys():
                m = 100 - 90 + (90 * n * documents) // words
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, k, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=repr)


def given(seed=1, n=700):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(400)] + ["Été", "漢字", "x1", "THE", "the", "a-b", "don't"]
    weights = [1 / (i + 1) for i in range(len(lexicon))]
    docs = [(i, " ".join(rng.choices(lexicon, weights, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[17][1]) for i in range(300)]  # a large group of copies: ties
    docs += [(5000, None), (5001, ""), (5002, " !!! "), (None, docs[3][1]), (4, "again w1"), (4, "again w1"), (5003, "w2 " * 30_000)]
    items = [(i, " ".join(rng.choices(lexicon, k=rng.randint(1, 25)))) for i in range(60)]
    items += [(100, docs[17][1]), (101, None), (102, "--"), (103, "absent word"), (None, "w1 w2"), (5, "w7 more"), (5, "w7 more"), (104, "THE The the")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, rank int, terms string"),
            spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int"))


def searched(spark, docs, items):
    return sorted((tuple(r) for r in rs.report(*frames(spark, docs, items)).collect()), key=repr)


def test_report_equals_model(spark):
    docs, items = given()
    assert searched(spark, docs, items) == model(docs, items)


def test_small_trees_and_slices(spark, monkeypatch):
    for name, value in (("SLICE_WORDS", 150), ("TREE_CELLS", 900), ("SEED_SHARE", 2)):
        monkeypatch.setattr(rs, name, value)
    docs, items = given(2, 300)
    assert searched(spark, docs, items) == model(docs, items)


def test_empty_tables(spark):
    docs, items = given()
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []
    assert searched(spark, [(1, None)], items) == []


def test_different_terms_of_one_hash_are_told_apart():
    import pyarrow as pa

    words = rs.Terms([(1, "alpha beta"), (2, "gamma")])
    words.hashes = np.zeros(3, np.uint64)
    words.order, words.most_alike = np.arange(3), 3
    block = next(rs.word_blocks(pa.array(["gamma x beta", "alpha betas"])))
    block.__dict__["hashes"] = np.zeros(5, np.uint64)
    where, which = words.find(block)
    assert sorted(zip(where.tolist(), which.tolist())) == [(0, 2), (2, 1), (3, 0)]


def test_most_pairs_are_pruned():
    """Items about some documents do not make the search look at all of them."""
    rng = np.random.default_rng(2)
    n, vocabulary = 4096, 512
    terms_of = [np.unique(np.append(rng.integers(0, 16, 6), 16 + (i // 8) % 496)) for i in range(n)]
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in terms_of])])
    weights = np.where(np.arange(vocabulary) < 16, 10, 9000)
    import pyarrow as pa

    tree = rs.DocumentTree(pa.array(range(n)), firsts, np.concatenate(terms_of), np.full(firsts[-1], 500_000), weights)
    of_item = [np.array([1, 2, 3, 20 + i]) for i in range(100)]
    search = rs.Search(rs.item_tree(of_item, weights), 100, weights, 8, None)
    search.add(tree)
    assert search.pairs < n * 100 / 10
    for item, found in enumerate(search.best):
        scores = sorted((-500_000 * int(weights[np.intersect1d(t, of_item[item])].sum()), True, i) for i, t in enumerate(terms_of))
        assert found == scores[:8]
