"""Near-duplicate texts by a set-similarity join: rare-first prefixes with length, positional and suffix filters.

Texts become sets of words or word n-grams, equal sets one class. Tokens are put in one global order, rare first. Two
classes with Jaccard similarity t share their first common token within a prefix of each set. If that token is rare, it
is the join key. If it is frequent, all their common tokens are, and n-grams of two tokens of the prefix are keys instead.
Say the sets can differ in at most H tokens, and take r with r (STEP + 1) > H. Between the first r + 1 common tokens there
are r gaps with at most H tokens of both sets in them, so in one gap there are at most STEP: two common tokens that follow
each other at a distance of at most STEP + 1 in both sets, within a prefix that is r + 1 tokens longer. So all pairs of
frequent tokens at such distances in that prefix are keys: they grow with the length of a text, not with its square.
Frequent keys are found on a sample and split in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import free_shuffles, materialise, release

#: Tokens are counted in this many cells; the cells, not the vocabulary, are sent to the tasks (4 MB at any size).
CELLS = 1 << 20
#: A token whose cell holds more sets than this is joined on together with the set's next common one.
FREQUENT = 500
#: Tokens that may lie between the two of an n-gram.
STEP = 2
#: Sets up to this size are told apart by parities of 128 parts, larger ones by those of 64 and counts in eight.
PARITY = 100
#: Indexed sets of a key in one block; keys that are split at most; one of how many sets is counted to find them.
BLOCK, HOT_KEYS, HOT_SAMPLE = 20_000, 10_000, 64


def token_sets(df: DataFrame, key: str, text: str, ngram: int, least: int, whole: bool = False) -> DataFrame:
    """(key, tokens): sorted distinct 64-bit hashes of word n-grams of texts with at least `least` different ones.

    Words are the longest runs of letters or digits of the lower-cased text. A text of fewer than `ngram` words has one
    n-gram, all its words. Texts without words or with fewer n-grams are left out; if `whole`, they have no tokens.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    out = df.select(F.col(key).alias("key"), words.alias("w"))
    if ngram == 1:
        tokens = F.transform(F.array_distinct("w"), lambda x: F.xxhash64(x))
    else:
        at = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (ngram - 1)))).otherwise(F.array().cast("array<int>"))
        tokens = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, ngram), " ")))
    out = out.select("key", F.array_sort(F.array_distinct(tokens)).alias("tokens"))
    enough = F.size("tokens") >= max(1, least)
    return out.withColumn("tokens", F.when(enough, F.col("tokens")).otherwise(F.array().cast("array<long>"))) if whole else out.where(enough)


def _overlap(a: int, b: int, t: float) -> int:
    """Common tokens that sets of a and b tokens need for similarity t."""
    return math.ceil(t / (1 + t) * (a + b) - 1e-9)


_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX2


def _keys_of(ids: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, cells: np.ndarray, threshold: float, frequent: int, probe_side: bool):
    """(key, row, place of its last token, tokens in the key) of sets given end to end.

    The larger set of a pair probes, the smaller one is indexed with its shorter prefix.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    count = cells[tokens & (CELLS - 1)]
    order = np.lexsort((tokens, count, row))
    tokens, count = tokens[order].view(np.uint64), count[order]
    place = np.arange(len(tokens)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    share = threshold if probe_side else 2 * threshold / (1 + threshold)
    prefix = sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + 1
    often = count > frequent
    rare = np.flatnonzero(~often & (place < prefix[row]))
    keys, rows, places, grams = [tokens[rare]], [row[rare]], [place[rare]], [np.ones(len(rare), np.int64)]
    # a set can only be like another by its frequent tokens if it has enough of them
    able = np.bincount(row[often], minlength=len(sizes)) >= np.ceil(threshold * sizes - 1e-9)
    # differing tokens of the pair: the partner of a probing set has at most its size, that of an indexed one up to size / threshold
    differ = np.floor((1 - threshold) / (1 + threshold) * sizes * (2 if probe_side else 1 + 1 / threshold) + 1e-9).astype(np.int64)
    last = np.minimum(prefix + differ // (STEP + 1) + 1, sizes - 1)
    at = np.flatnonzero(often & able[row] & (place < last[row]))
    for step in range(1, STEP + 2):
        first = at[place[at] + step <= last[row[at]]]
        keys.append(_mixed(tokens[first]) + tokens[first + step])
        rows.append(row[first])
        places.append(place[first + step])
        grams.append(np.full(len(first), 2, np.int64))
    return np.concatenate(keys).view(np.int64), np.concatenate(rows), np.concatenate(places), np.concatenate(grams)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)


def _prefix_keys(sent, threshold: float, frequent: int, probe_side: bool):
    """Keys of each class: (k, d, parities, more parities or counts, size, place * 2 + tokens in the key - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, hot, blocks = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                tokens, sizes = _lists(part.column(1))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                k, r, p, g = _keys_of(ids, tokens, sizes, cells, threshold, frequent, probe_side)
                row = np.repeat(np.arange(len(sizes)), sizes)
                mixed = _mixed(tokens.view(np.uint64))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                # which of 128 parts have an odd number of tokens
                bit = (mixed >> np.uint64(33)) & np.uint64(127)
                sig, high = (np.bitwise_xor.reduceat(np.where(bit // 64 == h, np.left_shift(np.uint64(1), bit % np.uint64(64)), np.uint64(0)), starts).view(np.int64) for h in (0, 1))
                # counts above 255 stay there; a difference of two such counts is never more than the true one
                counts = np.minimum(np.bincount(row * 8 + (mixed >> np.uint64(40)).astype(np.int64) % 8, minlength=8 * len(sizes)), 255).astype(np.uint64).reshape(-1, 8)
                # large sets have the counts in place of the second half of the parities, which they would drown
                packed = np.where(sizes <= PARITY, high, (counts << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64).view(np.int64))
                if len(hot):
                    # a frequent key is cut in blocks of indexed sets; the probing set goes to each of them
                    where = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
                    cut = np.where(hot[where] == k, blocks[where], 1)
                    if probe_side:
                        again = np.repeat(np.arange(len(k)), cut)
                        block = np.arange(len(again)) - np.repeat(np.cumsum(cut) - cut, cut)
                        k, r, p, g = k[again], r[again], p[again], g[again]
                    else:
                        block = np.mod(ids[r], cut)
                    k = np.where(block > 0, (k.view(np.uint64) + block.astype(np.uint64) * _MIX2).view(np.int64), k)
                cols = [k, ids[r], sig[r], packed[r], sizes[r].astype(np.int32), (p * 2 + g - 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "d", "sig", "c", "n", "m"])

    return run


def _hot_keys(classes: DataFrame, cells: np.ndarray, threshold: float, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that more than BLOCK indexed sets have, by a sample of the classes, and the blocks each is cut into.

    At most HOT_KEYS, the most frequent ones. Splitting only spreads the work: results don't depend on the sample.
    """
    sent = classes.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, sizes = _lists(b.column(1))
            k, *_ = _keys_of(b.column(0).to_numpy(zero_copy_only=False), tokens, sizes, sent.value, threshold, frequent, False)
            yield pa.RecordBatch.from_arrays([pa.array(k)], ["k"])

    some = classes.where(F.pmod(F.xxhash64("d"), F.lit(HOT_SAMPLE)) == 0).select("d", "tokens").mapInArrow(run, "k long")
    found = some.groupBy("k").agg((F.count(F.lit(1)) * HOT_SAMPLE).alias("n")).where(F.col("n") > BLOCK).orderBy(F.desc("n"), "k").limit(HOT_KEYS).orderBy("k").toArrow()
    return found.column(0).to_numpy(), -(-found.column(1).to_numpy() // BLOCK)


def similar_classes(classes: DataFrame, threshold: float, frequent: int = FREQUENT) -> DataFrame:
    """(a, b): all pairs of different classes (d, tokens) with Jaccard similarity of at least threshold, each once."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    spark = classes.sparkSession
    cell = classes.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(CELLS - 1).cast("int").alias("cell")).count()
    counted = cell.toArrow()  # at most CELLS rows
    cells = np.zeros(CELLS, np.int32)
    cells[counted.column(0).to_numpy()] = np.minimum(counted.column(1).to_numpy(), 2**31 - 1)
    sent = spark.sparkContext.broadcast((cells, *_hot_keys(classes, cells, threshold, frequent)))
    sets = classes.select("d", "tokens")
    a, b = (sets.mapInArrow(_prefix_keys(sent, threshold, frequent, side), "k long, d long, sig long, c long, n int, m int").alias(n) for n, side in (("a", True), ("b", False)))
    need = f"cast(ceil({threshold / (1 + threshold):.17g}D * (a.n + b.n) - 1e-9D) as int)"
    # the suffix filter's bound on the tokens that one set lacks, in parts of all tokens: by parities, or by counts of large sets
    apart = " + ".join(f"abs((shiftrightunsigned(a.c, {8 * i}) & 255) - (shiftrightunsigned(b.c, {8 * i}) & 255))" for i in range(8))
    cond = f"""a.k = b.k and (b.n < a.n or (b.n = a.n and b.d < a.d)) and b.n >= {threshold:.17g}D * a.n - 1e-9D
      and bit_count(a.sig ^ b.sig) + if(a.n <= {PARITY}, bit_count(a.c ^ b.c), 0) <= a.n + b.n - 2 * {need}
      and (a.m & 1) = (b.m & 1) and least(a.n - shiftright(a.m, 1), b.n - shiftright(b.m, 1)) + (a.m & 1) * least(shiftright(a.m, 1), shiftright(b.m, 1)) >= {need}
      and (b.n <= {PARITY} or {apart} <= a.n + b.n - 2 * {need})"""
    pairs = a.join(b, F.expr(cond)).select(F.col("a.d").alias("a"), F.col("b.d").alias("b")).distinct()
    left = classes.select(F.col("d").alias("a"), F.col("tokens").alias("ta"))
    right = classes.select(F.col("d").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_c", common)
    return both.where(F.col("_c") >= threshold * (F.size("ta") + F.size("tb") - F.col("_c")) - 1e-9).select("a", "b")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, ngram: int = 5, least: int = 1, frequent: int = FREQUENT, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (key, d) of every text with its class, pairs (a, b) of similar classes.

    Texts with equal token sets are one class, numbered by its smallest key. Every pair of classes at or above the
    threshold is found: the filters only drop pairs that can't reach it, and each is verified once. Texts that are null,
    empty, without words or have under `least` tokens are in no class; if `whole`, each is a class of its own.
    """
    sets = token_sets(df, key, text, ngram, least, whole)
    number = F.coalesce(F.col("key").try_cast("long"), F.xxhash64("key"))
    sets = materialise(sets.select("key", number.alias("d"), "tokens", F.xxhash64("tokens").alias("h1"), F.hash("tokens", F.size("tokens")).alias("h2")), "sets")
    bare = sets.where("size(tokens) = 0").select("key", "d")
    full = sets.where("size(tokens) > 0")
    classes = materialise(full.groupBy("h1", "h2").agg(F.min("d").alias("d"), F.first("tokens").alias("tokens")), "classes")
    members = materialise(full.select("key", "h1", "h2").join(classes.select("h1", "h2", "d"), ["h1", "h2"]).select("key", "d"), "members")
    if whole:
        members = members.unionByName(bare)
    else:
        # the tokens are in the classes now
        release(sets)
        free_shuffles(members)
    pairs = materialise(similar_classes(classes, threshold, frequent), "pairs")
    return members, pairs


def components(pairs: DataFrame) -> DataFrame:
    """(d, root): smallest class of each connected group of pairs, by passing on minima and doubling pointers."""
    edges = materialise(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    label = materialise(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("d"), F.least("x", "m").alias("root")), "labels")
    while True:
        near = edges.join(label.select(F.col("d").alias("y"), "root"), "y").groupBy(F.col("x").alias("d")).agg(F.min("root").alias("near"))
        low = label.join(near, "d").select("d", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("d").alias("root"), F.col("root").alias("far"))
        new = low.join(jump, "root", "left").select("d", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        new = materialise(new, "labels")
        same = new.where("old <> root").isEmpty()
        release(label)
        label = new.select("d", "root")
        label._talklake_path = new._talklake_path
        if same:
            return label


def document_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y): class pairs and copies within classes, written out as pairs of keys in either order once."""
    m1, m2 = members.select(F.col("key").alias("x"), F.col("d").alias("a")), members.select(F.col("key").alias("y"), F.col("d").alias("b"))
    across = pairs.join(m1, "a").join(m2, "b").select("x", "y")
    within = m1.join(m2, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(within)


def grouped(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, class_id, group_id, n_links): one row per text; n_links counts the other texts it is similar to."""
    sizes = members.groupBy("d").agg(F.count(F.lit(1)).alias("size"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(sizes.select(F.col("d").alias("b"), "size"), "b").groupBy(F.col("a").alias("d")).agg(F.sum("size").alias("others"))
    per_class = sizes.join(links, "d", "left").join(components(pairs), "d", "left")
    per_class = per_class.select("d", F.coalesce("root", "d").alias("group_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(per_class, "d").select("key", F.col("d").alias("class_id"), "group_id", "n_links")
