"""Archives: round trips, revisits, and files that any Zstandard reader can read."""

import base64
import glob
import hashlib
import random
import struct

import zstandard

from roadloom.llm import warc

BODY = "<html><body>" + "text and more text " * 40 + "</body></html>"
PAGES = [(i, f"http://a.example/{i}", BODY + str(i % 37), "x") for i in range(120)]
PAGES += [(500, None, None, "x"), (501, "u\r\nv", "", "x"), (None, "http://n", BODY + "1", "x"), (None, None, "only null", "x")]
PAGES += [(7, "http://a.example/7", BODY + "7", "x")] * 3 + [(502, "u", "P*M\x18\0\0\0\0" * 50 + "é漢", "x"), (503, "u", "z" * 300_000, "x")]


def model(rows):
    """The response of each payload is the row of the smallest id."""
    out, groups = [], {}
    for row in rows:
        groups.setdefault(row[2] or "", []).append(row[0])
    for payload, ids in groups.items():
        data = payload.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first, *others = sorted(ids, key=lambda i: (i is None, i or 0))
        out.append((first, len(data), digest, "response", None))
        out += [(i, len(data), digest, "revisit", first) for i in others]
    return sorted(out, key=repr)


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(i, u, h, "k", 3) for i, u, h, _ in rows], "page_id long, url string, html string, key string, size int")


def test_what_is_read_back(spark):
    got = warc.archive_and_read(frame(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == model(PAGES)


def test_payloads_survive_and_files_are_plain_zstandard(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(frame(spark), path)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert back["502"] == PAGES[-2][2] and back["503"] == "z" * 300_000 and back["0"] == BODY + "0"
    files = [f for f in glob.glob(path + "/part-*")]
    records = 0
    for name in files:
        data = open(name, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_MAGIC
        words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        text = zstandard.ZstdDecompressor(dict_data=words).stream_reader(data[8 + size :], read_across_frames=True).read()
        records += text.count(b"WARC/1.1\r\n")
    assert records == len(PAGES)


def test_random_payloads(spark):
    rng = random.Random(8)
    rows = [(i, "u", "".join(rng.choices("\0P*M\x18\r\n<>é", k=rng.randint(0, 60))), "x") for i in range(400)]
    assert sorted(map(tuple, warc.archive_and_read(frame(spark, rows)).collect()), key=repr) == model(rows)


def test_small_tables(spark):
    assert warc.archive_and_read(frame(spark).limit(0)).count() == 0
    assert sorted(map(tuple, warc.archive_and_read(frame(spark, PAGES[:1])).collect()), key=repr) == model(PAGES[:1])


def test_the_dictionary_comes_from_distinct_payloads(spark, monkeypatch):
    """200,000 pages of 100 payloads: all of them are sampled, and a dictionary is trained."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    bodies = ["<html>" + " ".join(rng.choices(words, k=300)) + "</html>" for _ in range(100)]
    kept = spark.createDataFrame(list(enumerate(bodies)), "k long, html string")
    pages = spark.range(200_000).selectExpr("id AS page_id", "id % 100 AS k").join(kept, "k")
    seen = []
    build = warc.build_dictionary
    monkeypatch.setattr(warc, "build_dictionary", lambda samples: seen.append(samples) or build(samples))
    dictionary = warc.dictionary_of(pages, "html")
    assert sorted(seen[0]) == sorted(b.encode() for b in bodies)
    assert dictionary[:4] == bytes.fromhex("37a430ec")  # a trained dictionary begins so
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 30)
    warc.dictionary_of(pages, "html")
    assert len(seen[1]) == 30 and set(seen[1]) < set(seen[0])
