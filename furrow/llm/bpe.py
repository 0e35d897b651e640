"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

Encoding works on the pieces that the vocabulary's pre-tokenizer cuts. Within a piece an
Aho-Corasick automaton over all tokens gives, for every start, the tokens that match there; the
encoder walks along longest matches, checks each new token against the one before it in a
pair-compatibility table, takes the next shorter match if they can't stand side by side, and steps
back if none is left. The token row it ends with is the one that the merges give, and no position
is entered twice from a dead end, so the work is linear in the piece. Decoding gathers the bytes of
all ids by one table of offsets into the concatenated tokens.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern for byte-level vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids, and pairs whose fit, a worker remembers; a memory is emptied when it is full.
REMEMBERED = 150_000
PAIRS = 200_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + k)] = b
    return names


class Vocabulary:
    """Tokens and special tokens of one file, with the offset table that decodes them."""

    def __init__(self, path: str):
        self._load(path)

    def _load(self, path: str) -> tuple[dict, dict[str, bytes]]:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        known = spec["pre_tokenizer"] or {}
        model = spec["model"]
        if known.get("type") != "ByteLevel" or known.get("add_prefix_space") or not known.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        names = _byte_names()
        raw = {token: bytes(names[c] for c in token) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with stripping rules are not supported")
        every = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        size = np.zeros(max(every) + 2, dtype=np.int64)
        for i, t in every.items():
            size[i + 1] = len(t)
        self.offsets = np.cumsum(size)
        self.bytes = np.frombuffer(b"".join(every.get(i, b"") for i in range(max(every) + 1)), dtype=np.uint8)
        return model, raw

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered through the offset table; ids outside it have none."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)].astype(np.int64)
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(first - (ends - size), size)].tobytes()


class Codec(Vocabulary):
    """A vocabulary with its merges, ready to encode too."""

    def __init__(self, path: str):
        model, raw = self._load(path)
        #: pair -> (rank, merged id), and for each merged id the pair and rank that make it.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (raw[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((left, right), (rank, made))
            self.parts.setdefault(made, (left, right, rank))
        self._fits: dict[int, bool] = {}  # by left << 20 | right
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.reached = {i for i, t in self.tokens.items() if self._by_merging(t) == [i]}
        #: Token lengths, and for each token the longest other token that it begins with, or -1.
        self.length = [0] * (max(self.tokens) + 1)
        self.shorter = [-1] * len(self.length)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.trie = ahocorasick.Automaton()
        for i in self.reached:
            data = self.tokens[i]
            self.length[i] = len(data)
            self.shorter[i] = next((j for n in range(len(data) - 1, 0, -1) if (j := self.ids.get(data[:n])) in self.reached), -1)
            if len(data) > 1:
                self.trie.add_word(data.decode("latin-1"), i)
        self.trie.make_automaton()
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.memory: dict[str, bytes] = {}

    def _by_merging(self, data: bytes) -> list[int]:
        """The plain rule: merge the pair of lowest rank, the leftmost first, until none is left."""
        row = [self.ids[bytes([b])] for b in data]
        while len(row) > 1:
            rank, at = min((self.rank.get((row[k], row[k + 1]), (1 << 60,))[0], k) for k in range(len(row) - 1))
            if rank == 1 << 60:
                break
            row[at : at + 2] = [self.rank[row[at], row[at + 1]][1]]
        return row

    def fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table: may the two tokens stand side by side in an encoding?

        Undo, latest first, the merges that made either side; the pair stands unless the tokens that
        face each other at the seam at some time would merge earlier than what was undone last.
        """
        key = left << 20 | right
        known = self._fits.get(key)
        if known is not None:
            return known
        none = (-1, -1, -1)
        latest, a, b, good = 1 << 60, left, right, True
        left_first = False  # of equal ranks the left merge is done first
        while True:
            rank = self.rank.get((a, b), (1 << 60,))[0]
            if rank < latest or rank == latest and left_first:
                good = False
                break
            ra, rb = self.parts.get(a, none), self.parts.get(b, none)
            if ra[2] < 0 and rb[2] < 0:
                break
            if ra[2] > rb[2]:
                latest, a, left_first = ra[2], ra[1], False
            else:
                latest, b, left_first = rb[2], rb[0], True
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[key] = good
        return good

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one piece, by backtracking over longest matches."""
        whole = self.ids.get(data)
        if whole is not None and whole in self.reached:
            return [whole]
        length, shorter, fits, single = self.length, self.shorter, self._fits, self.single
        longest = [single[b] for b in data]
        for end, token in self.trie.iter(data.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends rise, so the longest comes last
        n, at, last, row = len(data), 0, -1, []
        dead: set[int] = set()
        token = longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    good = fits.get(last << 20 | token)
                    if good if good is not None else self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                row.append(token)
                if end == n:
                    return row
                at, last, token = end, token, longest[end]
            else:
                # No token may follow here: give up the last one and go on with a shorter one.
                dead.add(at)
                gone = row.pop()
                at -= length[gone]
                last = row[-1] if row else -1
                token = shorter[gone]

    def _ids(self, piece: str) -> bytes:
        got = array("i", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 200:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers in the machine's order."""
        out: list[bytes] = []
        at = 0
        for mark in self.split.finditer(text) if self.split else ():
            out.append(self._plain(text[at : mark.start()]))
            out.append(array("i", [self.special[mark[0]]]).tobytes())
            at = mark.end()
        out.append(self._plain(text[at:] if at else text))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        memory = self.memory
        return b"".join([memory.get(p) or self._ids(p) for p in self.pieces.findall(text)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One offset table per Python worker, for workers that only decode."""
    return Vocabulary(path)


def encode(text: Column | str, path: str) -> Column:
    """array<int> of a text's token ids; null and empty texts have none. Whole texts, no truncation."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for texts in batches:
            done = [own.encode(t.as_py()) if t.is_valid else b"" for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in done)])
            flat = pa.array(np.frombuffer(b"".join(done), dtype=np.int32))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return ids(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, path: str) -> Column:
    """The text of an array of token ids; null gives an empty text, broken UTF-8 the replacement sign."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        for rows in batches:
            flat, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            yield pa.array([own.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())

    return texts(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<int>")))


def round_trip(text: Column | str, path: str) -> Column:
    """struct<ids array<int>, decoded string>: a text's token ids and what they decode to, by one worker.

    As ``encode`` and then ``decode`` on its ids, but a task holds one Python worker for both. Null and
    empty texts have no ids and decode to an empty text, repeated rows are coded alike, an empty table
    gives no rows, and no other column is read.
    """

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for texts in batches:
            ids = [np.frombuffer(own.encode(t.as_py()) if t.is_valid else b"", dtype=np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
            decoded = pa.array([own.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), decoded], names=["ids", "decoded"])

    return both(F.col(text) if isinstance(text, str) else text)
