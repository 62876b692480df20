"""Chunking against a byte-by-byte model, and the comparison against a plain loop."""

import hashlib
import random

import numpy as np

from roadloom.llm import chunk_prints as c

ROWS = [(i * 3 % 101, "".join(random.Random(i % 60).choices("abcdefgh éß漢 \n", k=(i % 60) ** 2 // 2)), 1, "x") for i in range(150)]
ROWS += [(None, "null id", 1, "x"), (None, None, 1, "x"), (4, None, 1, "x"), (5, "", 1, "x"), (6, "long words " * 4000, 1, "x")] + [(7, "same", 1, "x")] * 3


def slow_ends(data: bytes) -> list[int]:
    ends, at = [], 0
    while len(data) - at > c.MIN:
        for end in range(at + c.MIN, len(data) + 1):
            value = 0
            for b in data[max(0, end - 32) : end]:
                value = (value * 2 + int(c.GEAR[b])) % 2**32
            bits = c.STRICT_BITS if end - at < c.NORMAL else c.LOOSE_BITS
            if value >> (32 - bits) == 0 or end - at == c.MAX or end == len(data):
                break
        at = end
        ends.append(at)
    return ends + ([len(data)] if at < len(data) else [])


def test_chunks_equal_the_model():
    rng = random.Random(1)
    for size in [0, 1, 15, 16, 17, 63, 64, 257, 900, 2500]:
        for data in (rng.randbytes(size), bytes(size), bytes(rng.choices(b"ab c", k=size))):
            assert c.fingerprint(data)[1] == slow_ends(data)


def test_an_edit_reuses_chunks_exactly():
    rng = random.Random(2)
    for _ in range(200):
        body = bytes(rng.choices(b"abcdefgh \n", k=rng.randint(0, 700)))
        kept = rng.randint(0, len(body))
        edited = body[:kept] + bytes(rng.choices(b"xyz abc", k=rng.randint(0, 300)))
        assert c.fingerprint_after(edited, kept, body, c.fingerprint(body)[1]) == c.fingerprint(edited)[0]


def test_an_insertion_leaves_most_chunks():
    body = random.Random(3).randbytes(20000)
    moved = c.fingerprint(body[:5000] + b"inserted" + body[5000:])[0]
    assert c.likeness(c.fingerprint(body)[0], moved) > 0.95
    assert c.read_print(c.written(moved)) == moved


def plain(rows):
    """One row for each document, by the contract's words."""
    import pyspark.sql.functions  # noqa: F401

    out = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        changed = len(text) // 4
        edited = text[: len(text) - changed] + following[:changed]
        prints = [c.fingerprint(t.encode())[0] for t in (text, edited, following)]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), c.written(prints[0]), c.written(prints[1]),
                    c.likeness(prints[0], prints[1]), c.likeness(prints[0], prints[2])))
    return out


def test_comparison_equals_the_plain_loop(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, range int, hash string")
    ordered = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    ordered = sorted(ordered, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = sorted(plain([(r.doc_id, r.text) for r in ordered]), key=repr)
    for range_bytes in (1 << 30, 3000, 1):
        got = c.compare_with_edits(docs, range_bytes=range_bytes).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_small_tables(spark):
    docs = spark.createDataFrame(ROWS[:1] + [(9, "only one text, but a long one " * 9, 1, "x")], "doc_id long, text string, range int, hash string")
    assert c.compare_with_edits(docs.limit(0)).count() == 0
    one = c.compare_with_edits(docs.where("doc_id = 9")).first()
    assert one.near_next == 1.0 and one.fingerprint and one.n_chars == 270
    assert c.with_fingerprints(docs).count() == 2
