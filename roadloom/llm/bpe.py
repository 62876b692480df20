"""Byte-pair encoding by backtracking, and decoding by an offset table.

A piece of text is a string over the vocabulary's base symbols. The encoder walks it from
the left and always takes the longest token that an Aho-Corasick automaton finds at the
current place and that may stand after the token before it; where no token fits, it takes
the last token back and tries the next shorter one there. Two tokens may stand side by
side if merging their joined text by rank leaves the boundary between them in place, which
a table of such pairs remembers. A sequence of tokens whose neighbours all fit is the one
the merges give, and a place that was left once is never entered again, so the work grows
linearly with the piece.

Decoding gathers the tokens' texts from one byte string by an offset table.

Letters, numbers, lower case and composition are those of the library's Unicode tables.

Null is encoded like the empty text, to no tokens. Repeated documents are encoded each on
their own; columns other than the named ones are not looked at, and of a kept column that is
named like a result's only the result stays. A very long text is encoded as a whole, so a
task holds its tokens at once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from roadloom.llm.rows import parts
from roadloom.llm.shipping import ship_package

#: Pieces in each of the two generations whose tokens a worker remembers: some 60 MB each.
REMEMBERED_PIECES = 300_000
REMEMBERED_PAIRS = 300_000

# Fixed values of the vocabulary's format.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges(codes: list[int]) -> str:
    """Ascending code points as the ranges of a character class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Characters:
    """Letters, numbers, composition and lower case as in the library's Unicode tables.

    Python's and the regular expressions' tables may be of other versions. They agree on
    what Python knows, which hardly changes any more; of the characters that Python does not
    assign, the library's own tables say which are letters or numbers, and texts that hold
    one are composed and lower-cased by the library.
    """

    def __init__(self):
        codes = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
        text = "".join(map(chr, codes))
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        classes = []
        for name in ("L", "N"):
            found = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "isolated").pre_tokenize_str(text)
            theirs = [ord(piece) for piece, _ in found if len(piece) == 1 and self._is(name, piece)]
            classes.append(rf"[[\p{{{name}}}--[{_ranges(codes)}]]{'[' + _ranges(theirs) + ']' if theirs else ''}]")
        letter, number = classes
        self.known_pieces = regex.compile(CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^" + WHITE_SPACE + r"\p{L}\p{N}]+")
        self.all_pieces = regex.compile(rf"{CONTRACTIONS}|{letter}+|{number}|[^{WHITE_SPACE}{letter}{number}]+", regex.V1)

    def _is(self, name: str, character: str) -> bool:
        return not pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed").pre_tokenize_str(character)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, composed and in lower case; white space only parts them."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.all_pieces.findall(self.normalizer.normalize_str(text))
        # A capital sigma has one lower case, wherever it stands.
        return self.known_pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Ranked merges over base symbols: which tokens may stand side by side."""

    def __init__(self, parts: dict[int, tuple[int, int]], rank: dict[int, int]):
        self.parts = parts
        self.merged = {pair: token for token, pair in parts.items()}
        self.rank = rank
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, tokens: list[int]) -> list[int]:
        """All merges done one by one, the leftmost of the lowest rank first."""
        while len(tokens) > 1:
            due = [self.rank.get(self.merged.get(pair, -1), float("inf")) for pair in zip(tokens, tokens[1:])]
            i = due.index(min(due))
            if due[i] == float("inf"):
                break
            tokens = [*tokens[:i], self.merged[tokens[i], tokens[i + 1]], *tokens[i + 2 :]]
        return tokens

    def may_follow(self, left: int, right: int) -> bool:
        pair = left, right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self._boundary_stays(left, right)
        return known

    def _boundary_stays(self, left: int, right: int) -> bool:
        """Undo the merges of both sides from the last one; no pair across the boundary may ever be due.

        At any time the side whose last merge came later is taken apart. The two tokens
        that then touch the boundary stood there until ``until``, so a merge of them that
        ranks before that would have been made.
        """
        rank, parts, merged, until = self.rank, self.parts, self.merged, float("inf")
        while True:
            joined = merged.get((left, right))
            if joined is not None and rank[joined] < until:
                return False
            left_rank, right_rank = rank.get(left, -1), rank.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            # Of equal merges the left one is made first, so the right one is undone first.
            # A merge across the boundary comes between them in place, hence the half.
            if left_rank > right_rank:
                until, left = left_rank, parts[left][1]
            else:
                until, right = right_rank + 0.5, parts[right][0]


class Vocabulary:
    """An encoder and a decoder of a byte-level BPE vocabulary file with word ends."""

    def __init__(self, content: str):
        described = json.loads(content)
        model = described["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        # A symbol is a letter, or a letter that ends its word: that one moves up by 1000.
        symbols = {text: self._symbols(text) for text in ids}
        rank, parts = {}, {}
        for place, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = ids[left + right]
            rank[token], parts[token] = place, (ids[left], ids[right])
        self.merges = Merges(parts, rank)
        base = {text: ids[text] for text in ids if len(symbols[text]) == 1}
        by_symbol = {symbols[text]: token for text, token in base.items()}
        self.automaton = ahocorasick.Automaton()
        for text, token in ids.items():
            # A token that its own text does not give can never occur.
            if token not in parts or self.merges.merge([by_symbol[x] for x in symbols[text]]) == [token]:
                self.automaton.add_word(symbols[text], (token, len(symbols[text])))
        self.automaton.make_automaton()
        added = {token["content"]: token["id"] for token in described.get("added_tokens", [])}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = Characters().pieces
        texts = {token: text for text, token in ids.items()} | {token: text for text, token in added.items()}
        size = max(texts, default=-1) + 1
        self.text_table = OffsetTable([(texts.get(i, "") + " ").encode() for i in range(size)])
        self.number_table = OffsetTable([b"%d " % i for i in range(size)])
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}

    def _symbols(self, text: str) -> str:
        if self.end and text.endswith(self.end) and text != self.end:
            body = text[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 1000)
        return text

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of a piece between white space."""
        word = "".join([self.letters[b] for b in piece.encode()])
        if self.end:
            word = word[:-1] + chr(ord(word[-1]) + 1000)
        size = len(word)
        found: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, (token, length) in self.automaton.iter(word):
            # The tokens of one place are met from short to long.
            found[last + 1 - length].append((length, token))
        fits, may_follow = self.merges.fits, self.merges.may_follow
        taken: list[tuple[int, int, int]] = []  # place, token, how many shorter ones are left there
        dead = bytearray(size + 1)
        at, left, before = 0, len(found[0]), -1
        while at < size:
            tokens = found[at]
            while left:
                left -= 1
                length, token = tokens[left]
                if dead[at + length]:
                    continue
                fit = before < 0 or fits.get((before, token))
                if fit is None:
                    fit = may_follow(before, token)
                if fit:
                    taken.append((at, token, left))
                    at, before = at + length, token
                    left = len(found[at]) if at < size else 0
                    break
            else:
                dead[at] = 1
                if not taken:
                    raise ValueError(f"the vocabulary cannot express {piece!r}")
                at, _, left = taken.pop()
                before = taken[-1][1] if taken else -1
        return tuple([token for _, token, _ in taken])

    def remembered(self, piece: str) -> tuple[int, ...]:
        """The tokens of a piece; what was not asked for lately is forgotten."""
        tokens = self.known_before.get(piece) or self.encode_piece(piece)
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED_PIECES:
                self.known_before, self.known = self.known, {}
            self.known[piece] = tokens
        return tokens

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        runs = []
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                runs.append((self.added[part],))
            elif part:
                remembered = self.remembered
                runs += [self.known.get(piece) or remembered(piece) for piece in self.pieces(part)]
        return np.fromiter(chain.from_iterable(runs), np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a space between them, in UTF-8."""
        return self.text_table.gather(ids)[:-1]

    def numbers(self, ids: np.ndarray) -> bytes:
        return self.number_table.gather(ids)[:-1]


class OffsetTable:
    """Byte strings laid end to end, and where each begins."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(part) for part in parts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def gather(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        shift = np.repeat(self.offsets[ids] - (stops - sizes), sizes)
        shift += np.arange(stops[-1])
        return self.data[shift].tobytes()


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(content: str) -> Vocabulary:
    """The vocabulary of a file's content, built once per worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(content)
    return _vocabularies[key]


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns ``keep`` with ``ids``, their number and digest, and the digest of the decoded text.

    The vocabulary file is read where the driver runs and sent to the executors; it is a
    fixed file of a few megabytes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    results = ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    keep = tuple(name for name in keep if name not in results)
    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_tokens BIGINT"]
                       + ["ids ARRAY<INT>"] * with_ids + ["ids_sha256 STRING", "decoded_sha256 STRING"])

    def run(batches):
        words = vocabulary(sent.value)
        for batch in parts(batches, len(keep)):
            counts, ids_digests, text_digests, all_ids = [], [], [], []
            for one in batch.column(len(keep)):
                ids = words.encode(one.as_py())
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(words.numbers(ids)).hexdigest())
                text_digests.append(hashlib.sha256(words.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [*batch.columns[: len(keep)], pa.array(counts, pa.int64())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            columns += [pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)
