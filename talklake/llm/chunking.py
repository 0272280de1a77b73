"""Content-defined pieces of long texts, cut at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import DEFAULT, Bpe, encoder

#: Rank of the boundary after a word: end of a paragraph, a line, a sentence, a clause; 0 is any word.
_SENTENCE, _CLAUSE = ".!?。！？؟…", ",;:、，；،"
#: Words whose checksums make up the rolling hash, and its base and modulus.
WINDOW, BASE, MODULUS = 8, 1_000_003, (1 << 61) - 1
#: A landmark is a place where the rolling hash is divisible by this.
LANDMARK = 32


def _boundary(word: str) -> int:
    """Rank of the boundary after a word, by the word itself."""
    lines = word.count("\n")
    if lines:
        return 4 if lines > 1 else 3
    last = word.rstrip("\"')]}»”’*_` ")[-1:]
    return (2 if last in _SENTENCE else 1 if last in _CLAUSE else 0) if last else 0


def _landmarks(sums: list[int]) -> np.ndarray:
    """Whether the rolling hash of the last words is a landmark at each word."""
    x, h, power = np.array(sums, np.uint64), np.zeros(len(sums), np.uint64), 1
    for j in range(min(WINDOW, len(sums))):
        h[j:] += x[: len(x) - j] * np.uint64(power)
        power = power * BASE % (1 << 64)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(LANDMARK - 1) == 0


def _parts(bpe: Bpe, word: str, limit: int) -> Iterator[tuple[str, int, bool]]:
    """(part, tokens, landmark) of a word above the limit, cut where a rolling hash over its code points is a landmark.

    Parts have limit / 8 to limit code points, fewer if their tokens would exceed the limit.
    """
    least, h, top = max(1, limit // 8), 0, pow(BASE, WINDOW, MODULUS)
    places = []
    for i, c in enumerate(word):
        h = (h * BASE + ord(c) - (ord(word[i - WINDOW]) * top if i >= WINDOW else 0)) % MODULUS
        if i >= WINDOW - 1 and h % LANDMARK == 0:
            places.append(i + 1)
    at = k = 0
    while at < len(word):
        while k < len(places) and places[k] < at + least:
            k += 1
        mark = k < len(places) and places[k] <= at + limit
        step = (places[k] if mark else min(at + limit, len(word))) - at
        while (n := bpe.length(word[at : at + step])) > limit and step > 1:
            step, mark = max(1, step * limit // n if n > 2 * limit else step - max(1, step // 16)), False
        yield word[at : at + step], n, mark
        at += step


def _tail(bpe: Bpe, word: str, room: int) -> int:
    """How many last code points of a word, not all of them, encode to at most `room` tokens."""
    low, high = 0, 1
    while high < len(word) and len(bpe.word(word[-high:])) <= room:
        low, high = high, 2 * high
    high = min(high, len(word))
    while high - low > 1:
        k = (low + high) // 2
        if len(bpe.word(word[-k:])) <= room:
            low = k
        else:
            high = k
    return low


def chunk(bpe: Bpe, text: str, limit: int, least: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text in code points; tokens never exceed the limit.

    Words are the tokenizer's own, so a piece's length is the sum of its words' lengths, but for the pieces named below.
    From `least` to `limit` tokens, the first landmark of the rolling hash over the last words is taken and snapped to
    the nearest boundary of the best kind in that range; without a landmark the last such boundary is taken. Hash and
    boundaries depend on nearby words only, so an edit moves the cuts near it. The next piece begins `overlap` tokens
    before the cut: with as many whole words as fit, and of the word before them as many last code points as fill the
    rest. A word that leaves no room for the overlap, a long stretch without a blank, is first cut into parts by a
    rolling hash over its code points. Pieces that begin with a part of a word that joins the next, end in several words
    of white space or hold such parts are measured again as a whole.
    """
    words: list[str] = []
    sizes: list[int] = []
    cuts: dict[int, bool] = {}  # parts of over-long words, and whether a landmark ends them
    most = max(1, limit - overlap)
    sums: list[int] = []
    grades: list[int] = []
    known, measure = bpe.measures.get, bpe.measure
    for w in bpe.split(text):
        n, crc, grade = known(w) or measure(w, _boundary)
        if n <= most:
            words.append(w)
            sizes.append(n)
            sums.append(crc)
            grades.append(grade)
            continue
        for part, n, mark in _parts(bpe, w, most):
            cuts[len(words)] = mark
            words.append(part)
            sizes.append(n)
            sums.append(crc32(part.encode()))
            grades.append(_boundary(part))
    total = sum(sizes)
    if total <= limit or (cuts and (total := bpe.count(text)) <= limit):
        return [(0, len(text), total)]
    marks = _landmarks(sums).tolist()
    for i, mark in cuts.items():
        marks[i] = mark
    for i in range(len(words) - 1):
        # line ends in the white space that follows belong to the boundary
        if words[i + 1].isspace() and (lines := words[i].count("\n") + words[i + 1].count("\n")):
            grades[i] = 4 if lines > 1 else 3
    chars = [0, *accumulate(map(len, words))]
    out: list[tuple[int, int, int]] = []
    # fresh: first word not in any piece yet; the piece begins at code point `begin`, with `lead` tokens before word `start`
    # `joined`: the part of a word at the beginning doesn't stay a word of its own beside the next
    start, fresh, n, begin, lead, joined = 0, 0, len(words), 0, 0, False
    while True:
        size, i, first, landmark = lead, start, None, None
        while i < n and size + sizes[i] <= limit:
            size += sizes[i]
            if size >= least and i >= fresh:
                first = i if first is None else first
                landmark = i if landmark is None and marks[i] else landmark
            i += 1
        if i == n:
            cut = n - 1
        else:
            last = i - 1
            first = max(fresh, last) if first is None else first
            best = max(grades[first : last + 1], default=0)
            places = [k for k in range(first, last + 1) if grades[k] == best] or [last]
            cut = min(places, key=lambda k: (abs(k - landmark), k)) if landmark is not None else places[-1]
            cut = max(cut, fresh)
        size = lead + sum(sizes[start : cut + 1])
        blank = cut > start and not words[cut].strip() and not words[cut - 1].strip()
        if (lead and joined) or blank or (cuts and any(k in cuts for k in range(start, cut + 1))):
            # what is shared is given up before what is new
            while (size := bpe.count(text[begin : chars[cut + 1]])) > limit and (begin < chars[fresh] or cut > fresh):
                if begin < chars[fresh]:
                    begin += 1
                else:
                    cut -= 1
        out.append((begin, chars[cut + 1], size))
        if cut == n - 1:
            return out
        fresh, start, back, lead, previous = cut + 1, cut + 1, 0, 0, begin
        # room for at least the next new word must be left
        room = min(overlap, limit - sizes[fresh])
        while start and chars[start - 1] > previous and back + sizes[start - 1] <= room:
            start -= 1
            back += sizes[start]
        while cuts and start < fresh and bpe.count(text[chars[start] : chars[fresh]]) > overlap:
            back -= sizes[start]
            start += 1
        begin = chars[start]
        if start and back < room and begin - 1 > previous:
            begin -= min(_tail(bpe, words[start - 1], room - back), begin - 1 - previous)
            while begin < chars[start]:
                lead, joined = len(bpe.word(text[begin : chars[start]])), bpe.split(text[begin : chars[start + 1]])[0] != text[begin : chars[start]]
                blank = fresh - start > 1 and not words[fresh - 1].strip() and not words[fresh - 2].strip()
                if back + lead <= room and not ((joined or cuts or blank) and bpe.count(text[begin : chars[fresh]]) > overlap):
                    break
                begin += 1
            lead = lead if begin < chars[start] else 0


def split_texts(df: DataFrame, limit: int = 512, least: int = 256, overlap: int = 32, key: str = "doc_id", text: str = "text", path: str = DEFAULT) -> DataFrame:
    """(key, piece, start_char, end_char, n_tokens, text): each text as consecutive pieces of at most `limit` tokens.

    A text within the limit is one piece; null and empty texts have none. Neighbouring pieces share at most `overlap`
    tokens. A single code point above the limit (limits under 4) stays a piece of its own.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit must hold")
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece", "start_char", "end_char", "n_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows: list[int] = []
                cols: tuple[list, ...] = ([], [], [], [], [])
                for r, t in enumerate(part.column(1).to_pylist()):
                    for k, (s, e, n) in enumerate(chunk(bpe, t, limit, least, overlap) if t else ()):
                        rows.append(r)
                        for c, v in zip(cols, (k, s, e, n, t[s:e])):
                            c.append(v)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start_char int, end_char int, n_tokens int, text string")
