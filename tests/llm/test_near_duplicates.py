"""The join against all pairs, with groups of copies and of near copies, in one block and in many."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from roadloom.llm import near_duplicates as n


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def model(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if common * 5 >= both * 4:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    lowest, first = {}, {}
    order = lambda i: (i is None, i or 0)
    for k, (i, *_) in enumerate(rows):
        lowest[find(k)] = min(lowest.get(find(k), i), i, key=order)
        first[frozenset(sets[k])] = min(first.get(frozenset(sets[k]), i), i, key=order)
    return sorted(((i, lowest[find(k)], first[frozenset(sets[k])], links[k]) for k, (i, *_) in enumerate(rows)), key=repr)


def made(seed, base_words=120, groups=6, members=14):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    for _ in range(groups):
        base = [word() for _ in range(base_words)]
        for _ in range(members):
            text = base[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows += ["one two three", "ONE, two; three!", "one two", None, "", "...", "one two three four five", "one two three four five six"]
    rows += rows[:5] + ["again and again and again and again and again " * 800] * 2
    ids = rng.sample(range(1000), len(rows))
    return [(i, t, "x", 0) for i, t in zip(ids, rows)] + [(None, rows[0], "x", 0), (ids[3], rows[3], "x", 0)]


SCHEMA = "doc_id long, text string, key string, size int"


@pytest.mark.parametrize("seed,small_blocks", [(1, False), (2, True)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, small_blocks):
    if small_blocks:
        monkeypatch.setattr(n, "BUCKET_BLOCK", 4)
        monkeypatch.setattr(n, "CELL_BLOCK", 5)
        monkeypatch.setattr(n, "COLUMNS", 50)
    rows = made(seed)
    got = n.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in got), key=repr) == model(rows)


def test_links_are_counted_once_where_blocks_are_empty(spark, monkeypatch):
    monkeypatch.setattr(n, "CELL_BLOCK_ELEMENTS", 40)
    monkeypatch.setattr(n, "BUCKET_BLOCK", 1)
    rows = made(5, groups=12, members=3)
    got = n.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in got), key=repr) == model(rows)


def test_one_of_each_group_stays(spark):
    rows = made(3, groups=3, members=5)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = n.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {(i, c) for i, c, *_ in model(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in groups})


def test_empty_and_lonely_tables(spark):
    docs = spark.createDataFrame(made(4)[:1], SCHEMA)
    assert n.report(docs.limit(0)).count() == 0 and n.keep_one_of_each(docs.limit(0)).count() == 0
    assert [r.n_links for r in n.report(docs).collect()] == [0]


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = n.bands_and_rows(similarity, most=2_000)
        assert 1 - (1 - similarity**rows) ** bands >= n.RECALL


def test_minhash_estimates_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[250:1250]
    values = n.minhashes([a, b], 2000)
    assert abs((values[0] == values[1]).mean() - 750 / 1250) < 0.05


def test_counting_common_elements():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, size, dtype=np.uint64)) for size in (1, 50, 300, 300, 0, 7)]
    counts = n.common_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert Fraction(4, 5) == n.SIMILARITY
