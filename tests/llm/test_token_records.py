"""Token records: checksums, round trips against the library, file format, index."""

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadloom.llm import token_records as tr

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "plain words", "  two  spaces \n\n lines\t tab \x1c\x1d x", "!!!! !!!!", "a<|endoftext|>b <|endoftext|> \n c",
    "naïve café 漢字 😀  nb em 　 wide", "x" * 5000, "don't we'll I'm 1234 5,6.7", " \n ", "word " * 20_000, "tail  ",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert plain_crc32c(b"123456789") == 0xE3069283
    rng = random.Random(5)
    pieces = [bytes(rng.choices(range(256), k=rng.choice([0, 1, 2, 3, 7, 8, 31, 200]))) for _ in range(200)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    got = tr.crc32c(np.frombuffer(b"".join(pieces), np.uint8), offsets)
    assert got.tolist() == [plain_crc32c(p) for p in pieces]
    even = [p[: len(p) // 2 * 2] for p in pieces]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in even])])
    got = tr.crc32c(np.frombuffer(b"".join(even), np.uint8), offsets)
    assert got.tolist() == [plain_crc32c(p) for p in even]


def test_encoder_equals_library(monkeypatch):
    rng = random.Random(6)
    alphabet = " \n\t\r\x0b\x1c\x85   ab'sl1.é漢<|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    words = tr.Encoder(open(PATH, encoding="utf-8").read())
    assert [[*words.ids(t).tolist(), 0] for t in texts] == library(texts)
    assert [[*ids.tolist(), 0] for ids in words.ids_of(texts)] == library(texts)
    monkeypatch.setattr(tr, "LONG_TEXT", 100)
    monkeypatch.setattr(tr, "SEGMENTS", 3)
    monkeypatch.setattr(tr, "JOINED", 2)
    monkeypatch.setattr(tr, "REMEMBERED", 50)
    assert [[*ids.tolist(), 0] for ids in words.ids_of(texts)] == library(texts)


def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice"), (-5, "first")]
    return out


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, 9, "k") for i, t in rows()], "doc_id long, text string, file int, `before` string")


def model():
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids, start, out = library([t or "" for _, t in ordered]), 0, []
    for (doc_id, _), own in zip(ordered, ids):
        out.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_report_equals_model(docs):
    got = tr.report(docs, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    # Rows of one id are in the order of reading: starts tell them apart.
    same_id = [r for r in model() if r[0] == 3]
    assert sorted(map(tuple, got), key=lambda r: r[1])[:4] == model()[:4]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] == 3) == sorted((r[0], r[2], r[3]) for r in same_id)
    assert sorted(map(tuple, (r for r in got if r[0] != 3)), key=str) == sorted((r for r in model() if r[0] != 3), key=str)
    assert max(r[1] + r[2] for r in got) == sum(r[2] for r in model())


def test_files_are_plain_records_and_the_index_finds_them(spark, docs, tmp_path):
    path = str(tmp_path / "records")
    tr.write_records(docs, path, PATH)
    mark, n = tr.marker(open(PATH, "rb").read()), 0
    for name in sorted(glob.glob(f"{path}/part-*")):
        data, at = open(name, "rb").read(), 0
        while at < len(data):
            length, = struct.unpack_from("<Q", data, at)
            frame = data[at : at + 16 + length]
            tr.payloads([frame])
            n += frame != mark
            at += 16 + length
    assert n == len(rows())
    index = tr.write_index(tr.read_records(spark, path, PATH, with_ids=True), str(tmp_path / "index"))
    stored = {int(name.split("part-")[1][:5]): name for name in glob.glob(f"{path}/part-*")}
    expected = {(d, tuple(ids)) for (d, t), ids in zip(rows(), library([t or "" for _, t in rows()]))}
    order = tr.shuffled(index, 7).collect()
    assert [r.turn for r in order] != [r.turn for r in tr.shuffled(index, 8).collect()] and len(order) == len(rows())
    for r in order:
        with open(stored[r.file], "rb") as file:
            doc_id, ids = tr.read_at(file, r.offset, r.size)
        assert doc_id == r.doc_id and (doc_id, tuple(ids.tolist())) in expected


def test_damage_is_found():
    good = tr.frames([tr.packed(4, 0, 0, 0, np.arange(30), 2)])[0]
    for at in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            tr.payloads([bytes(bad)])


def test_scrambled_ids_come_back():
    ids = np.arange(1000)
    for width, scramble in ((2, 0), (2, 77), (4, 65535)):
        assert tr.unpacked(tr.packed(None, 1, 2, 3, ids, width, scramble))[1].tolist() == ids.tolist()


def test_empty_table(spark):
    assert tr.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
