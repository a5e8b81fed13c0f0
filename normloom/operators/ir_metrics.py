"""Retrieval metrics per query and their means, as window and aggregate plans.

``runs`` has by-columns, query, doc and rank (1 is best, no gaps, one row a document);
``qrels`` has query and doc.  A query without relevant documents scores 0; a query of
the run without hits has an infinite first rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import vocab

INFINITY = float("inf")
METRICS = ("hit", "recall", "precision", "mrr", "ap", "ndcg")


def judged(runs: DataFrame, qrels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs with is_rel, the number of relevant documents of the query and the running hits."""
    rel = qrels.select("query", "doc").distinct()
    total = rel.groupBy("query").agg(F.count("*").alias("n_rel"))
    w = Window.partitionBy(*by, "query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = runs.join(rel.withColumn("is_rel", F.lit(1)), ["query", "doc"], "left").join(total, "query", "left")
    out = out.na.fill(0, ["is_rel", "n_rel"])
    return out.withColumn("hits", F.sum("is_rel").over(w))


def _ideal(hits: Column, most: int) -> Column:
    """Sum of 1 / log2(i + 1) for i up to ``hits``, from a table of the first ``most`` sums."""
    sums = list(accumulate(1.0 / math.log2(i + 1.0) for i in range(1, most + 1)))
    return F.element_at(F.array(*map(F.lit, sums)), hits.cast("int"))


def per_query(runs: DataFrame, qrels: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = vocab.K_VALUES) -> DataFrame:
    """(by, query, k, hit, recall, precision, mrr, ap, ndcg, first_rank) for every k.

    One pass over the judged runs: the k values are columns of one aggregation and are
    turned into rows after it.  NDCG's ideal is made of the hits retrieved within k.
    """
    j = judged(runs, qrels, by)
    aggregates = []
    for k in ks:
        within = (F.col("rank") <= k) & (F.col("is_rel") == 1)
        aggregates += [
            F.coalesce(F.sum(F.when(within, 1)), F.lit(0)).alias(f"h{k}"),
            F.coalesce(F.sum(F.when(within, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias(f"a{k}"),
            F.coalesce(F.sum(F.when(within, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias(f"d{k}"),
        ]
    g = j.groupBy(*by, "query").agg(F.max("n_rel").alias("n_rel"), F.min(F.when(F.col("is_rel") == 1, F.col("rank"))).alias("first"), *aggregates)
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").cast("bigint").alias("h"), F.col(f"a{k}").alias("a"), F.col(f"d{k}").alias("d")) for k in ks))
    e = g.select(*by, "query", "n_rel", "first", F.inline(rows))
    found = F.col("first").isNotNull() & (F.col("first") <= F.col("k"))
    safe = F.when(F.col("n_rel") > 0, F.col("n_rel"))
    return e.select(
        *by,
        "query",
        "k",
        (F.col("h") > 0).cast("double").alias("hit"),
        F.coalesce(F.col("h") / safe, F.lit(0.0)).alias("recall"),
        (F.col("h") / F.col("k")).alias("precision"),
        F.when(found, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"),
        F.coalesce(F.col("a") / safe, F.lit(0.0)).alias("ap"),
        F.when(F.col("h") > 0, F.col("d") / _ideal(F.greatest(F.col("h"), F.lit(1)), max(ks))).otherwise(0.0).alias("ndcg"),
        F.when(found, F.col("first").cast("double")).otherwise(F.lit(INFINITY)).alias("first_rank"),
    )


def finite_mean(c: Column | str) -> Column:
    """Mean of the finite values, infinity if there are none."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(F.when(F.abs(col) < INFINITY, col)), F.lit(INFINITY))


def at_k(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over queries: (by, k, hit_rate, recall, precision, mrr, map, ndcg, mean_rank, num_queries)."""
    return scores.groupBy(*by, "k").agg(
        F.avg("hit").alias("hit_rate"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("mrr").alias("mrr"),
        F.avg("ap").alias("map"),
        F.avg("ndcg").alias("ndcg"),
        finite_mean("first_rank").alias("mean_rank"),
        F.count("*").alias("num_queries"),
    )


def chunk_hit_rate(runs: DataFrame, relevant_documents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of queries whose first chunk lies in a relevant document."""
    rel = relevant_documents.select("query", "document").distinct().withColumn("is_rel", F.lit(1.0))
    return runs.where("rank = 1").join(rel, ["query", "document"], "left").groupBy(*by).agg(F.avg(F.coalesce("is_rel", F.lit(0.0))).alias("chunk_hit_rate"))


def projected_qrels(runs: DataFrame, relevant_documents: DataFrame) -> DataFrame:
    """Chunk-level relevance inside a run: its chunks whose document is relevant."""
    return runs.join(relevant_documents.select("query", "document").distinct(), ["query", "document"], "left_semi").select("query", "doc").distinct()


def error_categories(runs: DataFrame, qrels: DataFrame, by: Sequence[str], k: int, deep: int = 20) -> DataFrame:
    """(by, query, category): success, partial, late_hit or complete_miss.

    success: all relevant documents within k; partial: some; late_hit: none within k but
    one within ``deep``; else complete_miss.  Queries without relevant documents are left out.
    """
    j = judged(runs, qrels, by).where("n_rel > 0")
    g = j.groupBy(*by, "query").agg(
        F.max("n_rel").alias("n_rel"),
        F.sum(F.when(F.col("rank") <= k, F.col("is_rel")).otherwise(0)).alias("near"),
        F.sum(F.when(F.col("rank") <= deep, F.col("is_rel")).otherwise(0)).alias("far"),
    )
    category = F.when(F.col("near") >= F.col("n_rel"), "success").when(F.col("near") > 0, "partial").when(F.col("far") > 0, "late_hit").otherwise("complete_miss")
    return g.select(*by, "query", category.alias("category"))


def shares(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, count, share) of each value within the by-columns."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by) if by else Window.partitionBy())
    return counts.withColumn("share", F.col("count") / total)
