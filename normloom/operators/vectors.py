"""Exact dense search and late interaction over array columns.

Blocks of vectors are multiplied as matrices inside ``mapInArrow``: the queries are a
stated set that is broadcast behind a check of its size (else split into several
passes).  Blocks are bounded on both sides, and a task keeps a running list of k rows a
query, so the shuffle carries k rows a query and task however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.arrays import first_of_groups
from normloom.operators.ranking import topk

#: Vectors on either side of one product, and rows that a task's list takes before it is cut.
BLOCK_SIDE = 1024
BLOCK_SCORES = 2_000_000
#: Numbers of query vectors that one broadcast may hold (64 MB as doubles).
BROADCAST_NUMBERS = 8_000_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


class _Best:
    """The k best documents of each query so far, larger worth first, then the larger key."""

    def __init__(self, k: int):
        self.k = k
        self.queries, self.keys, self.worth = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, first_query: int, keys: np.ndarray, worth: np.ndarray) -> None:
        """A block of scores, queries by documents."""
        n = worth.shape[1]
        if n > self.k:  # a little below the block's k-th, so that ties are cut by key later
            kth = np.partition(worth, n - self.k, axis=1)[:, n - self.k, None]
            q, d = np.nonzero(worth >= kth - 1e-8)
        else:
            q, d = (x.reshape(-1) for x in np.indices(worth.shape))
        self.held.append((q + first_query, keys[d], worth[q, d]))
        self.size += len(q)
        if self.size > BLOCK_SCORES:
            self.reduce()

    def reduce(self) -> None:
        self.queries, self.keys, self.worth = (np.concatenate(x) for x in zip((self.queries, self.keys, self.worth), *self.held))
        keep = first_of_groups(self.queries, (-np.round(self.worth, 9), -self.keys), self.k)
        self.queries, self.keys, self.worth = self.queries[keep], self.keys[keep], self.worth[keep]
        self.held, self.size = [], 0


def _blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, size):
        yield at, min(n, at + size)


def _search_step(held, k: int, metric: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        norms = (q * q).sum(axis=1)
        best = _Best(k)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = _matrix(b.column(1), q.shape[1])
            for lo, hi in _blocks(len(keys), BLOCK_SIDE):
                for first, last in _blocks(len(ids), BLOCK_SIDE):
                    s = q[first:last] @ m[lo:hi].T
                    if metric == "l2":
                        s = -(norms[first:last, None] + (m[lo:hi] * m[lo:hi]).sum(axis=1)[None, :] - 2 * s)
                    best.add(first, keys[lo:hi], s)
        best.reduce()
        yield pa.record_batch([pa.array(ids[best.queries]), pa.array(best.keys), pa.array(best.worth if metric == "ip" else -best.worth)], names=["query", "doc", "score"])

    return step


def _held(queries: DataFrame, column: str, numbers: str) -> Iterator[list]:
    """The queries' rows, in passes of at most ``BROADCAST_NUMBERS`` numbers each."""
    size = queries.agg(F.coalesce(F.sum(F.expr(numbers)), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-size // BROADCAST_NUMBERS))
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.hash("query"), F.lit(passes)) == p)
        yield part.select("query", column).collect()


def dense_topk(corpus: DataFrame, doc: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, metric: str = "ip") -> DataFrame:
    """(query, doc, score, rank) by inner product ("ip", larger first) or squared distance
    ("l2", smaller first).  Rows without a vector are left out; all vectors have one length."""
    if metric not in ("ip", "l2"):
        raise ValueError("metric must be ip or l2")
    spark = corpus.sparkSession
    asked = queries.select(F.col(query).cast("bigint").alias("query"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    rows = corpus.select(F.col(doc).cast("bigint").alias("doc"), F.col(vector).alias("v")).where("v is not null")
    found = spark.createDataFrame([], "query bigint, doc bigint, score double")
    for got in _held(asked, "v", "size(v)"):
        if got:
            held = spark.sparkContext.broadcast((np.array([r.query for r in got], dtype=np.int64), np.array([r.v for r in got], dtype=np.float64)))
            found = found.unionByName(rows.mapInArrow(_search_step(held, k, metric), "query bigint, doc bigint, score double"))
    return topk(found, ["query"], "score", "doc", k, descending=metric == "ip")


def _maxsim_step(held, k: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, q = held.value
        ends = np.append(starts[1:], len(q))
        best = _Best(k)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            m = _matrix(b.column(1).flatten(), q.shape[1])
            places = np.concatenate(([0], np.cumsum(counts)))
            at = 0
            while at < len(keys):  # documents with some BLOCK_SIDE vectors, a document at least
                to = max(at + 1, int(np.searchsorted(places, places[at] + BLOCK_SIDE, side="right")) - 1)
                part, heads = m[places[at] : places[to]], places[at:to] - places[at]
                first = 0
                while first < len(ids):
                    last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK_SIDE, side="right")) - 1)
                    last = len(ids) if last == len(ids) - 1 and ends[-1] - starts[first] <= BLOCK_SIDE else last
                    near = np.maximum.reduceat(q[starts[first] : ends[last - 1]] @ part.T, heads, axis=1)
                    best.add(first, keys[at:to], np.add.reduceat(near, starts[first:last] - starts[first], axis=0))
                    first = last
                at = to
        best.reduce()
        yield pa.record_batch([pa.array(ids[best.queries]), pa.array(best.keys), pa.array(best.worth)], names=["query", "doc", "score"])

    return step


def maxsim_topk(corpus: DataFrame, doc: str, vectors: str, queries: DataFrame, query: str, query_vectors: str, k: int) -> DataFrame:
    """(query, doc, score, rank) of multi-vectors (arrays of vectors): for each of the
    query's vectors the best product with one of the document's, summed.  Rows without
    vectors are left out."""
    spark = corpus.sparkSession
    cast = lambda c: F.col(c).cast("array<array<double>>")
    asked = queries.select(F.col(query).cast("bigint").alias("query"), cast(query_vectors).alias("v")).where("size(v) > 0")
    rows = corpus.select(F.col(doc).cast("bigint").alias("doc"), cast(vectors).alias("v")).where("size(v) > 0")
    found = spark.createDataFrame([], "query bigint, doc bigint, score double")
    for got in _held(asked, "v", "size(v) * size(v[0])"):
        if got:
            counts = np.array([len(r.v) for r in got])
            flat = np.array([x for r in got for x in r.v], dtype=np.float64)
            held = spark.sparkContext.broadcast((np.array([r.query for r in got], dtype=np.int64), np.cumsum(counts) - counts, flat))
            found = found.unionByName(rows.mapInArrow(_maxsim_step(held, k), "query bigint, doc bigint, score double"))
    return topk(found, ["query"], "score", "doc", k)
