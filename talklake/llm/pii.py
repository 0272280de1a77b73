"""Personal information in free text, by a skip-chain conditional random field.

Every token of every text is a node. Its potential is a sum over features of the token and its neighbours (word, shape,
endings, likeness to the names the archive knows, shape of the run of digits it stands in); neighbours share transition
potentials. Tokens that occur again in a document, however far apart, share skip potentials: one kind for a word that
comes again with the same neighbour, one for a word that comes again alone. Loopy message passing runs over both, and
the best labelling of each document under the resulting potentials is read off. Nothing is proposed beforehand: a text
without digits, signs or known names is labelled as any other. The weights were fitted by train_pii.py on texts planted
from templates and lie beside this file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zlib import crc32

TYPES = ["email", "phone", "id_number", "address", "name"]
#: none, then the beginning and the inside of each type.
LABELS = ["none", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
N_LABELS = len(LABELS)
#: Rounds of message passing over chains and skip links.
ROUNDS = 3
#: Offsets whose tokens' features speak for a label.
REACH = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
#: A document whose labels other than none all have less than this probability takes no further part.
FAINT = 1e-3

# white space belongs to the token after it; every character is in exactly one token
TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)|\s+")
INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")
_RUN = re.compile(r"[+＋(（]{0,2}\d+(?:\s?[-.()（）/ ]{0,2}\s?\d+)*")
_ZERO = re.compile(r"\d")


class Names:
    """What is known of names, in tables of fixed size however many names there are.

    cells: per cell of a name's hash, 1 for a given and 2 for a family name, added up; grams: the same for runs of four
    letters. Names share cells by chance only while they are far fewer than CELLS.
    """

    CELLS, GRAMS = 1 << 20, 1 << 16

    def __init__(self, cells: np.ndarray, grams: np.ndarray):
        self.cells, self.grams = cells, grams

    @staticmethod
    def keys(word: str) -> tuple[int, list[int]]:
        low = f"^{word}$"
        return crc32(low.encode()) % Names.CELLS, [crc32(low[i : i + 4].encode()) % Names.GRAMS for i in range(len(low) - 3)]

    @classmethod
    def of(cls, names: list[tuple[str, str]]) -> Names:
        cells, grams = np.zeros(cls.CELLS, np.uint8), np.zeros(cls.GRAMS, np.uint8)
        for name, part in names:
            bit = 1 if part == "given" else 2 if part == "family" else 0
            for w in re.findall(r"[^\W\d_]+", (name or "").lower()):
                if len(w) > 1:
                    k, g = cls.keys(w)
                    cells[k] |= bit
                    grams[g] |= bit
        return cls(cells, grams)

    def features(self, low: str) -> list[str]:
        k, g = self.keys(low)
        out = [f"known={c}"] if (c := int(self.cells[k])) else []
        if len(low) > 3:
            bits = self.grams[g]
            for bit, part in ((1, "given"), (2, "family")):
                share = float(((bits & bit) > 0).mean())
                out.append(f"like-{part}={min(4, int(share * 5))}")
        return out


def shape(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 12)}"
    if not w[0].isalpha():
        return "p"
    if len(w) == 1:
        return "X1" if w.isupper() else "x1"
    if w.islower():
        return "x"
    if w.isupper():
        return "XX"
    if w[0].isupper() and w[1:].islower():
        return "Xx"
    return "cjk" if w.lower() == w.upper() else "xX"


def token_features(tok: str, names: Names) -> tuple[list[str], str]:
    """Features of a token with its leading white space, and its class among few."""
    w = tok.lstrip()
    if not w:
        return ["end"], "end"
    gap = "" if len(w) == len(tok) else "n" if "\n" in tok else "s"
    s, out = shape(w), [f"gap={gap}"]
    if s[0] == "d":
        out += [f"s={s}", f"{gap}{s}"]
        if len(w) > 1 and w[0] == "0":
            out.append("zero" if w[1] != "0" else "zeros")
        return out, f"{gap}{s}"
    if s == "p":
        return [*out, f"p={w}", f"{gap}p={w}"], f"{gap}{w if w in PUNCT else '?'}"
    low = w.lower()
    out += [f"s={s}", f"{gap}{s}", f"w={low}", f"l={min(len(w), 12)}"]
    if len(w) > 3:
        out += [f"e3={low[-3:]}", f"e4={low[-4:]}"]
        if len(w) > 5:
            out.append(f"e6={low[-6:]}")
    near = names.features(low)
    out += near
    known = next((f for f in near if f[0] == "k"), "")
    like = next((f[-1] for f in near if f.startswith("like-family")), "0")
    return out, f"{gap}{s}{known}{'~' if like >= '3' and not known else ''}"


PUNCT = "@＠._-+()[]{}/,:;<>#'’\"=&"


@lru_cache(maxsize=100_000)
def _signature(run: str) -> tuple[str, ...]:
    """Features of a run of digits whose digits were replaced by zeros."""
    groups = [len(g) for g in re.findall("0+", run)]
    signs = "".join(sorted({c for c in re.sub(r"\s", " ", run) if c != "0"}))
    total = sum(groups)
    return (f"r={re.sub(r'\s', ' ', run)}", f"rg={'-'.join(map(str, groups))}", f"rn={min(total, 16)}", f"rs={signs}", f"rk={len(groups)}", f"rn{min(total, 16)}k{min(len(groups), 6)}")


def run_features(run: str) -> tuple[str, ...]:
    """Features of a run of digits as written: its shape, lengths of its groups, their sum, its signs, its beginning."""
    digits = run.lstrip("(（")
    head = "plus" if digits[0] in "+＋" else "zeros" if digits.startswith("00") else "zero" if digits[0] == "0" else "digit"
    return (*_signature(_ZERO.sub("0", run)), f"rh={head}")


class Field:
    """Weights of the field. Unknown features have none."""

    def __init__(self, features: list[str], weights: np.ndarray, classes: list[str], pairs: np.ndarray, runs: list[str], run_weights: np.ndarray, step: np.ndarray, skip: np.ndarray):
        #: weights: feature x offset x label; pairs: place x class x class x label; skip: kind x label x label
        self.index = {f: i for i, f in enumerate(features)}
        self.weights, self.pairs, self.run_weights = weights, pairs, run_weights
        self.classes = {c: i + 1 for i, c in enumerate(classes)}
        self.runs = {f: i for i, f in enumerate(runs)}
        self.step, self.skip = step, skip

    @classmethod
    def load(cls, path: str | None = None) -> Field:
        z = np.load(path or Path(__file__).with_name("pii_weights.npz"))
        names = json.loads(bytes(z["names"]).decode())
        return cls(names["features"], z["weights"].astype(np.float32), names["classes"], z["pairs"].astype(np.float32), names["runs"], z["run_weights"].astype(np.float32), z["step"].astype(np.float32), z["skip"].astype(np.float32))

    def save(self, path: str | None = None) -> None:
        names = json.dumps({"features": list(self.index), "classes": list(self.classes), "runs": list(self.runs)}, ensure_ascii=False).encode()
        half = {k: getattr(self, k).astype(np.float16) for k in ("weights", "pairs", "run_weights")}
        np.savez_compressed(path or Path(__file__).with_name("pii_weights.npz"), names=np.frombuffer(names, np.uint8), step=self.step, skip=self.skip, **half)


#: Places of the pairs of classes: (offset of the first, of the second) token from the one that is labelled.
PAIRS = ((-1, 0), (0, 1), (-2, -1), (1, 2))
#: Kinds of skip links.
WITH_NEIGHBOUR, ALONE = 0, 1


class Tagger:
    """A field with what is known of names: labels texts. Rows of potentials are kept per token seen."""

    KEEP = 150_000

    def __init__(self, field: Field, names: Names):
        self.field, self.names = field, names
        self.clear()

    def clear(self) -> None:
        n = len(REACH)
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, n, N_LABELS), np.float32)
        self.kinds = np.zeros(1024, np.int16)  # class of the token
        self.words = np.full(1024, -1, np.int64)  # number of its lower-case word if it may be linked, else -1
        self.numbers: dict[str, int] = {}
        self.run_ids: dict[str, int] = {}
        self.run_rows = np.zeros((256, N_LABELS), np.float32)

    def _add(self, tok: str) -> int:
        i = self.ids[tok] = len(self.ids)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.words = np.concatenate([self.words, np.full_like(self.words, -1)])
        feats, kind = token_features(tok, self.names)
        f = self.field
        at = [f.index[x] for x in feats if x in f.index]
        if at:
            self.rows[i] = f.weights[at].sum(0)
        self.kinds[i] = f.classes.get(kind, 0)
        low = tok.strip().lower()
        # words that aren't everyday ones, and numbers
        if len(low) > 2 and low[0].isalnum() and f"w={low}" not in f.index:
            self.words[i] = self.numbers.setdefault(low, len(self.numbers))
        return i

    def _add_run(self, run: str) -> int:
        i = self.run_ids[run] = len(self.run_ids) + 1
        if i >= len(self.run_rows):
            self.run_rows = np.concatenate([self.run_rows, np.zeros_like(self.run_rows)])
        at = [self.field.runs[x] for x in run_features(run) if x in self.field.runs]
        if at:
            self.run_rows[i] = self.field.run_weights[at].sum(0)
        return i

    def encode(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, their numbers end to end, numbers of digit runs, and each text's first place."""
        if len(self.ids) > self.KEEP or len(self.run_ids) > self.KEEP:
            self.clear()
        get, add, toks, flat, starts = self.ids.get, self._add, [], [], [0]
        runs: list[tuple[int, int, int]] = []
        for t in texts:
            found = TOKEN.findall(t)
            base = len(flat)
            for x in found:
                i = get(x)
                flat.append(add(x) if i is None else i)
            if _MANY(t):
                ends = np.cumsum([len(x) for x in found])
                for m in _RUN.finditer(t):
                    run = m.group()
                    if len(run) > 4:
                        r = self.run_ids.get(run) or self._add_run(run)
                        a, b = np.searchsorted(ends, [m.start(), m.end() - 1], side="right")
                        runs.append((base + int(a), base + int(b) + 1, r))
            toks.append(found)
            starts.append(len(flat))
        run_of = np.zeros(len(flat), np.int64)
        for a, b, r in runs:
            run_of[a:b] = r
        return toks, np.array(flat, np.int64), run_of, np.array(starts, np.int64)

    def potentials(self, flat: np.ndarray, run_of: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Node potentials; the neighbours of a token are those of its own text."""
        n = len(flat)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        out = self.rows[flat, REACH.index(0)] + self.run_rows[run_of]
        kinds = self.kinds[flat]
        for k, o in enumerate(REACH):
            if o and abs(o) < n:
                here = slice(-o, None) if o < 0 else slice(None, -o)
                there = slice(None, o) if o < 0 else slice(o, None)
                out[here] += np.where((doc[here] == doc[there])[:, None], self.rows[flat[there], k], 0)
        for p, (a, b) in enumerate(PAIRS):
            first, second = _shift(kinds, doc, a), _shift(kinds, doc, b)
            out += self.field.pairs[p][first, second]
        return out

    def links(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Skip links of all texts as pairs of places, each occurrence with the next one, and their kinds."""
        word = self.words[flat]
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        place = np.flatnonzero(word >= 0)
        if len(place) < 2:
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        order = place[np.lexsort((place, word[place], doc[place]))]
        a, b = order[:-1], order[1:]
        same = (word[a] == word[b]) & (doc[a] == doc[b]) & (b > a + 1)
        a, b = a[same], b[same]
        if not len(a):
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        full = self.words[flat]
        n = len(flat)
        beside = np.zeros(len(a), bool)
        for o in (-1, 1):
            x, y = np.clip(a + o, 0, n - 1), np.clip(b + o, 0, n - 1)
            beside |= (full[x] >= 0) & (full[x] == full[y]) & (doc[x] == doc[a]) & (doc[y] == doc[b])
        return np.stack([a, b], 1), np.where(beside, WITH_NEIGHBOUR, ALONE)

    def label(self, texts: list[str], rounds: int = ROUNDS) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Tokens of each text, labels end to end, first places."""
        toks, flat, run_of, starts = self.encode(texts)
        y = np.zeros(len(flat), np.int64)
        if not len(flat):
            return toks, y, starts
        unary = self.potentials(flat, run_of, starts)
        first, length = starts[:-1], np.diff(starts)
        belief = chains(unary, first, length, self.field.step)
        likely = np.maximum.reduceat(np.append(1 - np.exp(belief[:, 0]), 0), np.minimum(first, len(flat)))
        keep = np.flatnonzero((likely >= FAINT) & (length > 0))
        if not len(keep):
            return toks, y, starts
        pairs, kind = self.links(flat, starts)
        if len(pairs):
            doc = np.searchsorted(starts, pairs[:, 0], side="right") - 1
            used = np.isin(doc, keep)
            pairs, kind = pairs[used], kind[used]
        if len(pairs) and rounds:
            linked = np.unique(np.searchsorted(starts, pairs[:, 0], side="right") - 1)
            unary = unary + self.messages(unary, belief, pairs, kind, first[linked], length[linked], rounds)
        y_kept = best_paths(unary, first[keep], length[keep], self.field.step)
        for k, path in zip(keep, y_kept):
            y[first[k] : first[k] + length[k]] = path
        return toks, y, starts

    def messages(self, unary: np.ndarray, belief: np.ndarray, pairs: np.ndarray, kind: np.ndarray, first: np.ndarray, length: np.ndarray, rounds: int) -> np.ndarray:
        """What the skip links add to the node potentials after some rounds of message passing."""
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
        psi = np.exp(self.field.skip)[np.concatenate([kind, kind])]
        psi[len(pairs) :] = psi[len(pairs) :].transpose(0, 2, 1)
        sent = np.zeros((len(a), N_LABELS), np.float32)
        extra = np.zeros_like(unary)
        for r in range(rounds):
            x = belief[a] - sent[back]
            p = np.exp(x - x.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            m = np.log(np.einsum("ni,nij->nj", p, psi))
            sent = m - m.mean(1, keepdims=True)
            extra = np.zeros_like(unary)
            np.add.at(extra, b, sent)
            if r + 1 < rounds:
                belief = belief.copy()
                part = chains(unary + extra, first, length, self.field.step)
                at = _places(first, length)
                belief[at] = part[at]
        return extra


_MANY = re.compile(r"\d(?:\D{0,4}\d){3}").search


def _places(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(total)


def _shift(kinds: np.ndarray, doc: np.ndarray, o: int) -> np.ndarray:
    out = np.zeros_like(kinds)
    if o == 0:
        return kinds
    if abs(o) < len(kinds):
        here = slice(-o, None) if o < 0 else slice(None, -o)
        there = slice(None, o) if o < 0 else slice(o, None)
        out[here] = np.where(doc[here] == doc[there], kinds[there], 0)
    return out


def _blocks(first: np.ndarray, length: np.ndarray, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of like length side by side: (their numbers, places, whether a place is inside)."""
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    for lo in range(0, len(order), rows):
        pick = order[lo : lo + rows]
        at = np.arange(int(length[pick].max()))[None, :]
        inside = at < length[pick][:, None]
        yield pick, np.where(inside, first[pick][:, None] + at, first[pick][:, None]), inside


def chains(unary: np.ndarray, first: np.ndarray, length: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Log marginals of chains by forward and backward messages, scaled at each place; other places stay none."""
    out = np.zeros_like(unary)
    trans = np.exp(step)
    for pick, place, inside in _blocks(first, length):
        u = unary[place]
        e = np.exp(u - u.max(2, keepdims=True))
        n = place.shape[1]
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        f = e[:, 0]
        fwd[:, 0] = f = f / f.sum(1, keepdims=True)
        for t in range(1, n):
            f = (f @ trans) * e[:, t]
            fwd[:, t] = f = f / f.sum(1, keepdims=True)
        b = np.ones((len(pick), unary.shape[1]), np.float32)
        bwd[:, n - 1] = b
        for t in range(n - 2, -1, -1):
            x = (e[:, t + 1] * b) @ trans.T
            b = np.where(inside[:, t + 1][:, None], x / x.sum(1, keepdims=True), 1)
            bwd[:, t] = b
        p = fwd * bwd
        p = np.log(np.maximum(p / p.sum(2, keepdims=True), 1e-30))
        out[place[inside]] = p[inside]
    return out


def best_paths(unary: np.ndarray, first: np.ndarray, length: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    """The best labelling of each chain."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(first)
    for pick, place, inside in _blocks(first, length):
        u = unary[place]
        n = place.shape[1]
        back = np.zeros((len(pick), n, unary.shape[1]), np.int8)
        score = u[:, 0]
        for t in range(1, n):
            x = score[:, :, None] + step
            k = x.argmax(1)
            new = np.take_along_axis(x, k[:, None, :], 1)[:, 0] + u[:, t]
            live = inside[:, t][:, None]
            # past its end a chain keeps its score, and its label points to itself
            score = np.where(live, new, score)
            back[:, t] = np.where(live, k, np.arange(unary.shape[1]))
        y = np.zeros((len(pick), n), np.int64)
        y[:, n - 1] = score.argmax(1)
        for t in range(n - 1, 0, -1):
            y[:, t - 1] = np.take_along_axis(back[:, t], y[:, t][:, None], 1)[:, 0]
        for row, c in enumerate(pick):
            out[c] = y[row, : length[c]]
    return out


def find_items(tagger: Tagger, texts: list[str], rounds: int = ROUNDS) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of every item of each text, in code points; start is its first letter or digit."""
    clean, backs = [], []
    for raw in texts:
        back = None
        if not raw.isascii() and INVISIBLE.search(raw):
            back = [i for i, c in enumerate(raw) if not INVISIBLE.match(c)]
            raw = "".join(raw[i] for i in back)
        clean.append(raw)
        backs.append(back)
    toks, y, starts = tagger.label(clean, rounds)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for d in np.unique(np.searchsorted(starts, np.flatnonzero(y), side="right") - 1):
        at, run, kind = 0, None, 0
        for w, k in zip([*toks[d], ""], [*y[starts[d] : starts[d + 1]], 0]):
            # an item ends where none, another type or another beginning follows
            if run is not None and (k == 0 or k % 2 or (k + 1) // 2 != kind):
                if item := _item(clean[d], *run, TYPES[kind - 1]):
                    s, e = item
                    b = backs[d]
                    out[d].append((b[s], b[e - 1] + 1, TYPES[kind - 1]) if b else (s, e, TYPES[kind - 1]))
                run = None
            if k:
                run = (at, at + len(w)) if run is None else (run[0], at + len(w))
                kind = (int(k) + 1) // 2
            at += len(w)
    return out


def _item(text: str, s: int, e: int, kind: str) -> tuple[int, int] | None:
    """Extent without signs and blanks at the beginning and blanks at the end; None if it lacks what its type must have."""
    while s < e and not text[s].isalnum():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    body = text[s:e]
    digits = sum(c.isdigit() for c in body)
    letters = any(c.isalpha() for c in body)
    ok = {"email": letters and not body.isalpha(), "phone": digits >= 7, "id_number": digits >= 6, "address": digits > 0 and letters, "name": letters}[kind]
    return (s, e) if ok else None


_STATE: dict = {}


def _ready(sent) -> Tagger:
    """The process's tagger for these names."""
    if _STATE.get("names") is not sent:
        _STATE.update(names=sent, tagger=Tagger(Field.load(), Names(*sent.value)))
    return _STATE["tagger"]


def name_tables(names: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tables of Names, of fixed size, from a table (name, part_of_name) of any size. Nulls are no names."""
    w = names.where("part_of_name in ('given', 'family')").select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"), F.when(F.col("part_of_name") == "given", 1).otherwise(2).alias("bit"))
    w = w.where("length(w) > 1").withColumn("w", F.concat(F.lit("^"), "w", F.lit("$")))
    out = []
    for size, key in ((Names.CELLS, F.array("w")), (Names.GRAMS, F.transform(F.sequence(F.lit(1), F.length("w") - 3), lambda i: F.substring("w", i, F.lit(4))))):
        # at most `size` rows, whatever the number of names
        got = w.select(F.explode(key).alias("k"), "bit").groupBy((F.crc32(F.encode("k", "utf-8")) % size).cast("int").alias("k")).agg(F.bit_or("bit").cast("int").alias("bit")).toArrow()
        table = np.zeros(size, np.uint8)
        table[got.column(0).to_numpy()] = got.column(1).to_numpy()
        out.append(table)
    return out[0], out[1]


def _distinct(columns: list[list[str | None]]) -> list[str]:
    return list(dict.fromkeys(t for c in columns for t in c if t))


#: Texts labelled at a time.
TEXTS = 4000


def items(df: DataFrame, key: str, fields: list[str], names: DataFrame) -> DataFrame:
    """(key, field, pii_type, start_pos): one row per item; null and empty texts have none.

    names: the known names (name, part_of_name); they may be none or many, only tables of fixed size are sent. Texts that
    occur in several fields of a batch are read once. Repeated rows give their items once.
    """
    sent = df.sparkSession.sparkContext.broadcast(name_tables(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _ready(sent)
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                columns = [part.column(i + 1).to_pylist() for i in range(len(fields))]
                texts = _distinct(columns)
                found = dict(zip(texts, find_items(tagger, texts)))
                rows: list[int] = []
                cols: tuple[list, ...] = ([], [], [])
                for f, c in zip(fields, columns):
                    for r, t in enumerate(c):
                        for s, _, kind in found[t] if t else ():
                            rows.append(r)
                            for x, v in zip(cols, (f, kind, s)):
                                x.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], [key, "field", "pii_type", "start_pos"])

    return df.select(key, *fields).mapInArrow(run, f"`{key}` string, field string, pii_type string, start_pos int").distinct()


def redact(df: DataFrame, key: str, fields: list[str], names: DataFrame) -> DataFrame:
    """(key, fields): texts with every item replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]; nulls stay null."""
    sent = df.sparkSession.sparkContext.broadcast(name_tables(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _ready(sent)
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                columns = [part.column(i + 1).to_pylist() for i in range(len(fields))]
                texts = _distinct(columns)
                clean = {}
                for t, spans in zip(texts, find_items(tagger, texts)):
                    out, at = [], 0
                    for s, e, kind in sorted(spans):
                        if s >= at:
                            out += [t[at:s], f"[{kind.upper()}]"]
                            at = e
                    clean[t] = "".join([*out, t[at:]])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([clean[t] if t else t for t in c], pa.string()) for c in columns]], [key, *fields])

    return df.select(key, *fields).mapInArrow(run, ", ".join([f"`{key}` string", *[f"{f} string" for f in fields]]))
