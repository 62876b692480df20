"""The encoder against the tokenizers library and against merging step by step."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "", None, "Hello, World! 2024 don't they'll", "tabs\tand\n\nlines  ", "ÉCOLE œuvre ΣΑΣ İstanbul", "漢字 😀👍🏽 é",
    "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "!?#" * 3000, " ", "'s 'S ''re", "a b" * 20000,
]


def test_texts(ours, library):
    rng = random.Random(5)
    made = ["".join(rng.choice("aehinorst' \n.!<|>éß12") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    for text in [t or "" for t in TEXTS] + made:
        want = library.encode(text, add_special_tokens=False).ids
        got = ours.encode(text)
        assert got.tolist() == want
        assert ours.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_every_code_point_alone_and_between_letters(ours, library):
    codes = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(codes), 20_000):
        texts = [text for c in map(chr, codes[first : first + 20_000]) for text in (c, f"a{c}b")]
        for text, encoding in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
            assert ours.encode(text).tolist() == encoding.ids, text.encode()


def test_letters_of_other_unicode_versions_in_words(ours, library):
    """Runs of letters, numbers and marks, some of them beyond Python's tables."""
    rng = random.Random(11)
    alphabet = "aé1 .'\u0301" + "".join(map(chr, [
        0x1C89, 0x1C8A, 0xA7CB, 0xA7DC, 0x105C0, 0x10D50, 0x10D70, 0x10D40, 0x11382, 0x113C9, 0x113C2, 0x16100, 0x1612A, 0x16D63, 0x16D67, 0x16D70,
        0x1CCF0, 0x1E5F1, 0x2EBF0, 0x323B0, 0x3D000, 0x88F, 0xC5C, 0x20C1, 0x1FAE8]))
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 12)))
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text.encode("unicode_escape")


def test_pairs_agree_with_merging(ours):
    rng, merges = random.Random(3), ours.merges
    tokens = rng.sample(sorted(merges.parts), 400)
    base = lambda t: [t] if t not in merges.parts else base(merges.parts[t][0]) + base(merges.parts[t][1])
    for left, right in zip(tokens, tokens[1:]):
        if merges.merge(base(left)) == [left] and merges.merge(base(right)) == [right]:
            assert merges.may_follow(left, right) == (merges.merge(base(left) + base(right)) == [left, right])


def test_operator(spark, library):
    rows = [(i // 2, text, "x") for i, text in enumerate(TEXTS)] + [(None, "hello", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, PATH).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(ids), ids, digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
