"""Sets of queries against all rows: the best rows of each query by cosine or BM25, exactly.

Queries are taken in groups of bounded size. A group goes to all tasks, each scores it against its rows and keeps the
best of every query; these are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Queries sent to the tasks at a time, and rows scored at a time.
VECTOR_QUERIES, TEXT_QUERIES, ROWS = 2048, 128, 2048
#: Scores are compared as whole millionths; this stands for none.
NONE = -(1 << 62)


class _Best:
    """The best (millionths, id) of each query among the rows seen; equal scores go by id, falling or rising."""

    def __init__(self, queries: int, most: int, rising: bool):
        self.most, self.rising = most, rising
        self.score, self.ids = np.full((queries, 0), NONE, np.int64), np.zeros((queries, 0), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score: queries x rows, NaN for none."""
        whole = np.where(np.isnan(score), NONE, np.rint(np.nan_to_num(score) * 1e6).astype(np.int64))
        s = np.concatenate([self.score, whole], axis=1)
        i = np.concatenate([self.ids, np.broadcast_to(ids, whole.shape)], axis=1)
        if s.shape[1] > self.most:
            # all rows that may be among the best: those at or above the score in the last place
            last = np.partition(s, s.shape[1] - self.most, axis=1)[:, s.shape[1] - self.most]
            keep = np.zeros((len(s), self.most), np.int64)
            for q in range(len(s)):
                at = np.flatnonzero(s[q] >= last[q])
                keep[q] = at[np.lexsort((i[q, at] if self.rising else -i[q, at], -s[q, at]))[: self.most]]
            s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
        self.score, self.ids = s, i

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        q, k = np.nonzero(self.score != NONE)
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(self.ids[q, k]), pa.array(self.score[q, k] / 1e6)], ["query_id", "id", "score"])


def _merged(parts: list[DataFrame], most: int, rising: bool) -> DataFrame:
    both = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id") if rising else F.desc("id"))
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def _groups(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """The queries in groups of about `size`, by a hash of their id."""
    n = max(1, -(-queries.count() // size))
    for g in range(n):
        if (t := queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == g).toArrow()).num_rows:
            yield t


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the lists that have dims numbers and aren't zero."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)))
    v = lists.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    norm = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], v[good] / norm[good, None]


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _score_vectors(sent, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = sent.value
        best = _Best(len(q), most, False)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                rows, v = _matrix(_flat(part.column(1)), q.shape[1])
                best.add(q @ v.T, part.column(0).to_numpy(zero_copy_only=False)[rows])
        yield best.batch(query_ids)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, place): the `most` vectors (id, vector) of greatest cosine for each query (query_id, vector).

    Scores are rounded to six places; equal ones go by the greater id. Vectors that are zero, not finite or of another
    length than the query's have no score.
    """
    spark, parts = vectors.sparkSession, []
    v, queries = vectors.select("id", "vector").where("id is not null"), queries.select("query_id", "vector").where("query_id is not null")
    for dims in sorted(r[0] for r in queries.where("size(vector) > 0").select(F.size("vector")).distinct().collect()):
        for t in _groups(queries.where(F.size("vector") == dims), VECTOR_QUERIES):
            rows, q = _matrix(_flat(t.column(1)), dims)
            if len(rows):
                sent = spark.sparkContext.broadcast((t.column(0).to_numpy()[rows], q))
                parts.append(v.mapInArrow(_score_vectors(sent, most), "query_id long, id long, score double"))
    return _merged(parts or [spark.createDataFrame([], "query_id long, id long, score double")], most, False)


def nearest_to(vectors: DataFrame, query: list[float], most: int) -> DataFrame:
    """(id, score): nearest() for one query, which goes along with the code; each task hands on its best rows only."""
    q = np.asarray(query, np.float64)
    q = (q / np.sqrt(q @ q)).reshape(1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(1, most, False)
        for b in batches:
            rows, v = _matrix(_flat(b.column(1)), q.shape[1])
            best.add(q @ v.T, b.column(0).to_numpy(zero_copy_only=False)[rows])
        yield best.batch(np.zeros(1, np.int64)).select(["id", "score"])

    return vectors.select("id", "vector").where("id is not null").mapInArrow(run, "id long, score double").orderBy(F.desc("score"), F.desc("id")).limit(most)


def _score_texts(sent, most: int, rising: bool, k1: float, b: float, average: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vocabulary, place, query, idf = sent.value
        weights = np.zeros((len(vocabulary), len(query_ids)))
        weights[place, query] = idf
        best = _Best(len(query_ids), most, rising)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS // 8):
                part = batch.slice(lo, ROWS // 8)
                lists = _flat(part.column(1))
                n = np.asarray(pc.list_value_length(lists), dtype=np.int64)
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)[at >= 0]
                cell, tf = np.unique(row * len(vocabulary) + at[at >= 0], return_counts=True)
                row, word = cell // len(vocabulary), cell % len(vocabulary)
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[row] / average))
                score = np.zeros((len(n), len(query_ids)))
                ends = np.searchsorted(row, np.arange(len(n) + 1))
                for r in range(len(n)):
                    if ends[r] < ends[r + 1]:
                        score[r] = gain[ends[r] : ends[r + 1]] @ weights[word[ends[r] : ends[r + 1]]]
                best.add(np.where(score > 0, score, np.nan).T, part.column(0).to_numpy(zero_copy_only=False))
        yield best.batch(query_ids)

    return run


def best_texts(texts: DataFrame, queries: DataFrame, most: int, rising: bool, k1: float, b: float) -> DataFrame:
    """(query_id, id, score, place): the `most` texts (id, words) of greatest BM25 score for each query (query_id, words).

    A query is the set of all its different words; statistics are of all texts. Scores are rounded to six places; equal
    ones go by id, rising or falling. Texts without a word of the query have no score.
    """
    spark, parts = texts.sparkSession, []
    # cut into words once, not once per group of queries
    texts = materialise(texts.where("id is not null").select("id", "words"), "words")
    s = texts.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("words")).alias("avg")).first()
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    counts = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    asked = materialise(asked.join(counts, "word"), "asked")
    ids = asked.select("query_id").distinct()
    n = max(1, -(-ids.count() // TEXT_QUERIES))
    for g in range(n):
        t = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == g).toArrow()
        if t.num_rows:
            query_ids, query = np.unique(t.column("query_id").to_numpy(), return_inverse=True)
            coded = _flat(t.column("word")).dictionary_encode()
            df = t.column("df").to_numpy().astype(np.float64)
            sent = spark.sparkContext.broadcast((query_ids, coded.dictionary, coded.indices.to_numpy(), query, np.log(1.0 + (s["docs"] - df + 0.5) / (df + 0.5))))
            parts.append(texts.select("id", "words").mapInArrow(_score_texts(sent, most, rising, k1, b, s["avg"] or 1.0), "query_id long, id long, score double"))
    return _merged(parts or [spark.createDataFrame([], "query_id long, id long, score double")], most, rising)
