"""Byte-level BPE of whole texts with a public vocabulary.

The vocabulary file is a parameter; by default it is looked up among the public tokenizers on the machine and read once
per Python worker.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's published splitting pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks and words kept per worker; the tables are emptied when full, which costs time only.
KEEP = 300_000
#: A word this long isn't kept.
KEEP_CHARS = 200


# The standard library's expressions are several times faster and split alike, but for characters that they take for
# letters though Unicode counts them as numbers, and for separators they take for white space.
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""").findall
_RARE = frozenset("\x1c\x1d\x1e\x1f") | {c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")}
_SLOW = regex.compile(PATTERN).findall


def split(text: str) -> list[str]:
    """The words of a text by the vocabulary's pattern."""
    return _FAST(text) if _RARE.isdisjoint(text) else _SLOW(text)


class Bpe:
    """Encoder and decoder of one vocabulary of ranked byte strings."""

    def __init__(self, path: str = DEFAULT):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        if max(self.ranks.values(), default=0) >= 1 << 31:
            raise ValueError("ids must fit in 31 bits")
        self.strings = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        # merges by the ids of two neighbours, filled as they are met
        self.pairs: dict[int, int] = {}
        # ids are kept as machine integers, four bytes each
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # number of ids and checksum of words, and what the caller's function says of them
        self.measures: dict[str, tuple[int, int, int]] = {}
        self.split = split

    def _pair(self, a: int, b: int) -> int:
        """Rank of the merge of ids a and b, -1 if the vocabulary has none."""
        k = (a << 32) | b
        r = self.pairs.get(k)
        if r is None:
            r = self.pairs[k] = self.ranks.get(self.strings[a] + self.strings[b], -1)
        return r

    def word(self, text: str) -> list[int]:
        """Ids of one word: lowest merge rank first, leftmost among equals.

        Candidates wait in a priority queue as rank and place; symbols are a doubly linked list. An entry whose
        symbols have changed since it was queued is stale and skipped.
        """
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, pair, queue = self.pairs.get, self._pair, []
        for i in range(n - 1):
            if (r := known((ids[i] << 32) | ids[i + 1])) is None:
                r = pair(ids[i], ids[i + 1])
            if r >= 0:
                queue.append((r << 32) | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if ids[i] < 0 or (j := after[i]) >= n or known((ids[i] << 32) | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank, ids[k])) >= 0:
                    push(queue, (r << 32) | i)
            if (h := before[i]) >= 0 and (r := pair(ids[h], rank)) >= 0:
                push(queue, (r << 32) | h)
        return [x for x in ids if x >= 0]

    def plain(self, text: str) -> bytes:
        """Packed ids of any text, word by word."""
        out = []
        words = self.words
        for w in split(text):
            ids = words.get(w)
            if ids is None:
                ids = array("i", self.word(w)).tobytes()
                if len(w) <= KEEP_CHARS:
                    if len(words) >= KEEP:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def pieces(self, text: str) -> list[str]:
        """Pieces of text that encode on their own, without the blank that begins each but the first.

        A blank before a visible character always begins a word.
        """
        return _CUT(text) if _ODD(text) else text.split(" ")

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as machine integers of four bytes."""
        if not text:
            return b""
        parts = self.pieces(text)
        chunks = self.chunks
        get = chunks.get
        out = [self.plain(parts[0])]
        for p in parts[1:]:
            ids = get(p)
            if ids is None:
                ids = self.plain(" " + p)
                if len(p) <= KEEP_CHARS:
                    if len(chunks) >= KEEP:
                        chunks.clear()
                    chunks[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text without special tokens; null and empty texts have the empty list."""
        return array("i", self.packed(text)).tolist()

    def length(self, text: str) -> int:
        """Number of ids of a word or other short text."""
        ids = self.words.get(text)
        return len(self.plain(text) if ids is None else ids) // 4

    def measure(self, word: str, grade) -> tuple[int, int, int]:
        """Number of ids and checksum of a word, and its grade by a fixed function."""
        m = self.measures.get(word)
        if m is None:
            m = self.length(word), crc32(word.encode()), grade(word)
            if len(word) <= KEEP_CHARS:
                if len(self.measures) >= KEEP:
                    self.measures.clear()
                self.measures[word] = m
        return m

    def count(self, text: str | None) -> int:
        """Number of ids of a whole text."""
        return len(self.packed(text)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their byte strings, one after the other."""
        return b"".join([self.strings[i] for i in ids]).decode(errors="replace")


_ODD = re.compile(r" (?:\s|\Z)").search
_CUT = re.compile(r" (?=\S)").split


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT) -> Bpe:
    """The encoder of a vocabulary file, one per process."""
    return Bpe(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT, ids: str = "ids") -> DataFrame:
    """(key, ids): each row's text as ids. Rows with a null or empty text come out with an empty list, a null key stays."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            packed = [enc.packed(t) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, ids])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {ids} array<int>")


def measure_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT) -> DataFrame:
    """(key, n_tokens): each text's length in ids; 0 for null and empty texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.count(t) for t in b.column(1).to_pylist()], pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode_texts(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = DEFAULT) -> DataFrame:
    """(key, text): each row's ids as text; an empty list is the empty text, a null one null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
