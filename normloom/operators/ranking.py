"""Top-k, fusion of ranked lists and selection.

One place for the rules of ties: scores are compared rounded to nine digits, equal
ones by a unique key, so that a plan gives the same rows on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import vocab


def topk(df: DataFrame, by: Sequence[str], score: str, key: str, k: int, descending: bool = True, key_descending: bool = True, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; planned as a group limit before the shuffle."""
    s = F.round(F.col(score), 9)
    order = [s.desc_nulls_last() if descending else s.asc_nulls_last(), F.col(key).desc() if key_descending else F.col(key).asc()]
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(lists: Sequence[DataFrame], by: Sequence[str], key: str, k: int = vocab.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists with a ``rank`` column: one union, one aggregation.

    Columns: by, key, rrf and first_list, first_rank (place of first sight, for ties).
    """
    parts = [df.select(*by, key, "rank", F.lit(i).alias("list_no")) for i, df in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    seen = F.min(F.struct("list_no", "rank"))
    return (
        every.groupBy(*by, key)
        .agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), seen.alias("seen"))
        .select(*by, key, "rrf", F.col("seen.list_no").alias("first_list"), F.col("seen.rank").alias("first_rank"))
    )


def fuse_topk(lists: Sequence[DataFrame], by: Sequence[str], key: str, n: int, k: int = vocab.RRF_K) -> DataFrame:
    """The first n of the fused list; ties keep the order of first sight."""
    order = [F.round("rrf", 12).desc(), F.col("first_list"), F.col("first_rank")]
    return ranked(rrf(lists, by, key, k), by, order).where(F.col("rank") <= n)


def document_ranking(runs: DataFrame, by: Sequence[str], document: str) -> DataFrame:
    """Ranked documents of ranked chunks: each at the place of its first chunk."""
    first = runs.groupBy(*by, document).agg(F.min("rank").alias("first_rank"))
    return ranked(first, by, [F.col("first_rank")]).select(*by, document, "rank")


def document_cap(runs: DataFrame, by: Sequence[str], document: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` chunks a document, then the first k; ``runs`` has ranks."""
    w = Window.partitionBy(*by, document).orderBy("rank")
    kept = runs.withColumn("of_document", F.row_number().over(w)).where(F.col("of_document") <= cap)
    return ranked(kept.withColumnRenamed("rank", "old_rank"), by, [F.col("old_rank")]).where(F.col("rank") <= k).drop("of_document", "old_rank")


def select_constrained(
    candidates: DataFrame, query: str, key: str, k: int, max_per_document: int = 0, suppress_near_duplicates: bool = True, groups: Sequence[str] = vocab.GROUPS
) -> DataFrame:
    """Greedy selection per query: first one candidate of each evidence group, then by rank,
    under a cap a document and without near-duplicates within a document.

    ``candidates`` needs query, key, rank, evidence_group, document, fingerprint and comes
    from a top-k, so that a query's rows are bounded by it.  The choice is a fold over the
    query's ranked array: a row joins the chosen ones if they admit it.  Result: query, key,
    rank (order of choice).
    """
    fields = ("rank", key, "evidence_group", "document", "fingerprint")
    ranked_rows = candidates.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))

    def admitted(chosen: Column, row: Column) -> Column:
        beside = F.filter(chosen, lambda c: c["document"].eqNullSafe(row["document"]))
        ok = (F.size(chosen) < k) & ~F.exists(chosen, lambda c: c["rank"] == row["rank"])
        if max_per_document:
            ok = ok & (F.size(beside) < max_per_document)
        if suppress_near_duplicates:
            ok = ok & ~F.exists(beside, lambda c: c["fingerprint"].eqNullSafe(row["fingerprint"]))
        return ok

    def join(chosen: Column, row: Column, condition: Column) -> Column:
        return F.when(condition, F.concat(chosen, F.array(row))).otherwise(chosen)

    def first_of(group: str, so_far: Column) -> Column:
        had = F.size(so_far)
        of_group = F.filter("rows", lambda r: r["evidence_group"] == group)
        return F.aggregate(of_group, so_far, lambda c, r: join(c, r, (F.size(c) == had) & admitted(c, r)))

    chosen = F.filter("rows", lambda _: F.lit(False))
    for g in groups:  # a group's first candidate that the choice so far admits
        ranked_rows = ranked_rows.withColumn("chosen", first_of(g, chosen))
        chosen = F.col("chosen")
    picked = ranked_rows.select(query, F.posexplode(F.aggregate("rows", chosen, lambda c, r: join(c, r, admitted(c, r)))).alias("at", "row"))
    return picked.select(query, F.col("row")[key].alias(key), (F.col("at") + 1).alias("rank"))
