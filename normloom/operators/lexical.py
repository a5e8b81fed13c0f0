"""BM25 and sparse retrieval as joins on terms; the index is four ordinary tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions import vocab
from normloom.functions.arrays import first_of_groups, spread
from normloom.functions.text import tokens
from normloom.operators.ranking import topk
from normloom.tables import cut


def postings(docs: DataFrame, doc: str, text: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, term, doc, tf, doc_len); terms of one document are counted before any shuffle."""
    rows = docs.select(*groups, F.col(doc).alias("doc"), tokens(text).alias("t"))
    exploded = rows.select(*groups, "doc", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return exploded.groupBy(*groups, "term", "doc", "doc_len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_docs, avgdl); empty documents count."""
    return docs.select(*groups, F.size(tokens(text)).alias("n")).groupBy(*groups).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def term_idf(post: DataFrame, stats: DataFrame, groups: Sequence[str] = (), epsilon: float = vocab.BM25_EPSILON) -> DataFrame:
    """(groups, term, df, idf): ln((N - df + 0.5) / (df + 0.5)); negative ones become epsilon
    times the mean over all terms."""
    keys, post, stats = _keyed(groups, post, stats)
    df = post.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(stats), keys).withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row a group
    mean = raw.groupBy(*keys).agg(F.avg("raw_idf").alias("mean_idf"))
    both = raw.join(F.broadcast(mean), keys)
    return both.select(*groups, "term", "df", F.when(F.col("raw_idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))


def _keyed(groups: Sequence[str], *frames: DataFrame) -> tuple:
    """The groups' columns and the frames; without groups all rows are one group."""
    return (list(groups), *frames) if groups else (["_all"], *(df.withColumn("_all", F.lit(1)) for df in frames))


def bm25_scores(
    docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, groups: Sequence[str] = (), k1: float = vocab.BM25_K1, b: float = vocab.BM25_B
) -> DataFrame:
    """(groups, query, doc, score) of the documents that share a term with the query.

    Only postings of query terms are kept for the scoring join (a semi-join ahead of it);
    document frequencies still come from all of them.
    """
    post = postings(docs, doc, text, groups)
    stats = corpus_stats(docs, text, groups)
    idf = term_idf(post, stats, groups)
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(query_text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    keys, idf, stats = _keyed(groups, idf, stats)
    weights = idf.join(wanted, "term", "left_semi").join(F.broadcast(stats), keys)
    found = post.join(weights, [*groups, "term"]).withColumn(
        "part", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    )
    return found.join(asked, "term").groupBy(*groups, "query", "doc").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


#: Query and term pairs that one broadcast may hold (some 100 MB); more go in passes.
BROADCAST_PAIRS = 4_000_000
#: Scores (documents times queries) that a task holds at once.
BLOCK_SCORES = 2_000_000

Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]
Tokenize = Callable[[Column | str], Column]


def bm25_weight(avgdl: float, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> Weigh:
    """Weight of a term that stands ``tf`` times in a document of ``dl`` tokens, idf left out."""
    return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-12)))


def log_weight() -> Weigh:
    return lambda tf, dl: np.log1p(tf)


def _score_step(held, k: int, weigh: Weigh):
    """The k best documents a query of one partition, as a running list.

    Terms of a batch are looked up among the queries'; each (document, term) meets the
    queries that have the term; products are summed in a block of documents by queries.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vocabulary, bounds, owner_query, owner_weight = held.value
        terms = pa.array(vocabulary, pa.string())
        m = len(ids)
        rows_at_once = max(1, BLOCK_SCORES // max(1, m))
        best_q, best_d, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in batches:
            for lo in range(0, b.num_rows, rows_at_once):
                part = b.slice(lo, rows_at_once)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                lists = part.column(1)
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                found = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(keys)), length)[found >= 0]
                cell, inverse, tf = np.unique(row * len(vocabulary) + found[found >= 0], return_inverse=True, return_counts=True)
                row, term = cell // len(vocabulary), cell % len(vocabulary)
                if part.num_columns > 2:  # weights are given
                    weight = np.bincount(inverse, weights=part.column(2).flatten().to_numpy(zero_copy_only=False)[found >= 0], minlength=len(cell))
                else:
                    weight = weigh(tf.astype(np.float64), length[row].astype(np.float64))
                e, place = spread(bounds[term + 1] - bounds[term])
                at = bounds[term[e]] + place
                slot = owner_query[at] * len(keys) + row[e]
                score = np.bincount(slot, weights=weight[e] * owner_weight[at], minlength=m * len(keys)).reshape(m, len(keys))
                hit = np.bincount(slot, minlength=m * len(keys)).reshape(m, len(keys)) > 0
                score = np.where(hit, score, -np.inf)
                if len(keys) > k:
                    hit &= score >= np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k, None] - 1e-8
                q, d = np.nonzero(hit)
                best_q, best_d, best_s = np.concatenate((best_q, q)), np.concatenate((best_d, keys[d])), np.concatenate((best_s, score[q, d]))
                keep = first_of_groups(best_q, (-np.round(best_s, 9), -best_d), k)
                best_q, best_d, best_s = best_q[keep], best_d[keep], best_s[keep]
        yield pa.record_batch([pa.array(ids[best_q]), pa.array(best_d), pa.array(best_s)], names=["query", "doc", "score"])

    return step


def block_topk(docs: DataFrame, weights: DataFrame, k: int, weigh: Weigh | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best of ``docs(doc, terms)`` for ``weights(query, term, w)``.

    Without ``weigh`` the documents' weights are given: ``docs(doc, terms, weights)``.

    The queries are the stated side: their terms go to every task, in passes of at most
    ``BROADCAST_PAIRS``; a task sends on k rows a query, so neither postings nor scores of
    all pairs are ever shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc").cast("bigint"), "terms", *([] if weigh else [F.col("weights").cast("array<double>")]))
    n = weights.count()
    passes = max(1, -(-n // BROADCAST_PAIRS))
    found = spark.createDataFrame([], "query bigint, doc bigint, score double")
    for p in range(passes):
        part = weights if passes == 1 else weights.where(F.pmod(F.hash("query"), F.lit(passes)) == p)
        got = part.select(F.col("query").cast("bigint"), "term", F.col("w").cast("double")).toPandas()
        if got.empty:
            continue
        ids, q = np.unique(got["query"].to_numpy(), return_inverse=True)
        vocabulary, t = np.unique(got["term"].to_numpy().astype(str), return_inverse=True)
        order = np.argsort(t, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(vocabulary)))))
        held = spark.sparkContext.broadcast((ids.astype(np.int64), list(vocabulary), bounds, q[order].astype(np.int64), got["w"].to_numpy()[order]))
        found = found.unionByName(rows.mapInArrow(_score_step(held, k, weigh), "query bigint, doc bigint, score double"))
    return topk(found, ["query"], "score", "doc", k)


def query_terms(queries: DataFrame, query: str, text: str, tokenize: Tokenize = tokens) -> DataFrame:
    """(query, term, times) of queries."""
    return queries.select(F.col(query).alias("query"), F.explode(tokenize(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def bm25_topk(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, fill: bool = True, tokenize: Tokenize = tokens) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query.

    With ``fill`` documents without a shared term follow with score 0, those with the
    largest key first, until there are k.  A query with h < k hits needs at most the
    k + h largest keys for that, so only 2 k keys are looked at.
    """
    # tokens are made once and written; frequencies and scores read them
    rows = cut(docs.select(F.col(doc).cast("bigint").alias("doc"), tokenize(text).alias("terms")))
    # one pass for document frequencies and, under a null term, number and length of documents
    marked = F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))
    df = rows.select(F.size("terms").alias("n"), F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    df = cut(df)
    stats = df.where("term is null").select(F.col("df").alias("n_docs"), (F.col("n") / F.col("df")).alias("avgdl")).first()
    n_docs, avgdl = (stats.n_docs, stats.avgdl) if stats else (0, 0.0)
    raw = df.where("term is not null").withColumn("raw_idf", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf")).first()[0] or 0.0
    idf = F.when(F.col("raw_idf") < 0, F.lit(vocab.BM25_EPSILON * mean)).otherwise(F.col("raw_idf"))
    asked = query_terms(queries, query, query_text, tokenize)
    weights = cut(asked.join(raw.select("term", idf.alias("idf")), "term").select("query", "term", (F.col("times") * F.col("idf")).alias("w")))
    hits = block_topk(rows, weights, k, bm25_weight(avgdl))
    if not fill:
        return hits
    hits = cut(hits)  # k rows a query, needed twice
    last = [r.doc for r in docs.select(F.col(doc).cast("bigint").alias("doc")).where("doc is not null").orderBy(F.col("doc").desc()).limit(2 * k).collect()]
    if not last:
        return hits
    # a bounded list of keys for each query: 2 k rows a query
    spare = queries.select(F.col(query).alias("query")).distinct().select("query", F.explode(F.lit(last)).alias("doc")).join(hits.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return topk(hits.drop("rank").unionByName(spare), ["query"], "score", "doc", k)


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank) of sparse vectors with given weights: ``docs(doc, terms,
    weights)`` and ``queries(query, terms, weights)``; weights that are not positive do not count."""
    positive = F.filter(F.arrays_zip("terms", "weights"), lambda x: x["weights"] > 0)
    d = docs.select("doc", positive.alias("p")).select("doc", F.col("p.terms").alias("terms"), F.col("p.weights").alias("weights"))
    q = queries.select("query", F.inline(positive)).groupBy("query", F.col("terms").alias("term")).agg(F.sum("weights").alias("w"))
    return block_topk(d, q, k)
