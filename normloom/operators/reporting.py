"""Tables over metric rows: best and second systems, rankings, pivots, deltas, merges.

``metrics`` has dataset, level, model_key, method, k and the metric columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import vocab

KEYS = ("dataset", "level", "model_key", "method", "k")
METRICS = ("hit_rate", "recall", "precision", "mrr", "map", "ndcg", "mean_rank")
#: Pairs of methods that are compared, base first.
ABLATIONS = (
    ("bm25", "bm25_rerank", "reranker_gain_bm25"),
    ("dense", "dense_rerank", "reranker_gain_dense"),
    ("rrf", "rrf_rerank", "reranker_gain_rrf"),
    ("dense", "rrf", "hybrid_vs_dense"),
    ("bm25", "rrf", "hybrid_vs_bm25"),
)


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per key and value column."""
    return df.unpivot(list(keys), list(values), name, value)


def keep_last(df: DataFrame, keys: Sequence[str], sequence: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[s.desc() for s in sequence])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_metrics(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of metric tables; of equal keys the row of the last table wins."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_last(out, keys, [F.col("_source")]).drop("_source")


def at_report_k(metrics: DataFrame, k: int) -> DataFrame:
    """The rows at k; where a table has no such rows, those at its largest k."""
    best = metrics.agg(F.max(F.when(F.col("k") == k, F.col("k"))).alias("a"), F.max("k").alias("b")).select(F.coalesce("a", "b").alias("k"))
    return metrics.join(F.broadcast(best), "k", "left_semi")


def best_second(df: DataFrame, by: Sequence[str], system: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """(by, best_<system>, best_value, second_<system>, second_value, gap_to_second, num_compared)."""
    w = Window.partitionBy(*by).orderBy(F.round(F.col(value), 9).desc_nulls_last(), *(ties or [system]))
    r = df.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy(*by)))
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    g = r.groupBy(*by).agg(
        at(1, system).alias(f"best_{system}"), at(1, value).alias("best_value"), at(2, system).alias(f"second_{system}"), at(2, value).alias("second_value"), F.max("_c").alias("num_compared")
    )
    return g.withColumn("gap_to_second", F.col("best_value") - F.col("second_value"))


def comparison(metrics: DataFrame, names: Sequence[str] = ("hit_rate", "mrr", "ndcg")) -> DataFrame:
    """Best and second model per dataset, level, method, k and metric."""
    long = unpivot(metrics.select("dataset", "level", "model_key", "method", "k", *names), ["dataset", "level", "model_key", "method", "k"], names)
    return best_second(long, ["dataset", "level", "method", "k", "metric"], "model_key", "value")


def selection(metrics: DataFrame, value: str = "ndcg") -> DataFrame:
    """Best system per dataset and level, with the second one joined to it where there is one."""
    w = Window.partitionBy("dataset", "level").orderBy(F.round(F.col(value), 9).desc(), "model_key", "method")
    r = metrics.withColumn("_n", F.row_number().over(w))
    one = lambda n, p: r.where(F.col("_n") == n).select("dataset", "level", F.col("model_key").alias(f"{p}_model"), F.col("method").alias(f"{p}_method"), F.col(value).alias(f"{p}_{value}"))
    return one(1, "best").join(one(2, "second"), ["dataset", "level"], "left").withColumn(f"gap_{value}", F.col(f"best_{value}") - F.col(f"second_{value}"))


def global_means(metrics: DataFrame, by: Sequence[str] = ("model_key", "method"), values: Sequence[str] = ("hit_rate", "mrr", "ndcg")) -> DataFrame:
    return metrics.groupBy(*by).agg(*(F.avg(v).alias(f"mean_{v}") for v in values))


def ranked_by(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Equal values share the smallest rank, larger values first."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.round(F.col(value), 9).desc())
    return df.withColumn(name, F.rank().over(w))


def ablation_pivot(metrics: DataFrame, models: Sequence[str], values: Sequence[str] = ("hit_rate", "mrr", "ndcg"), methods: Sequence[str] = vocab.METHODS) -> DataFrame:
    """One row per method, one column metric__model; known methods first, then by name."""
    cells = [F.max(F.when(F.col("model_key") == m, F.col(v))).alias(f"{v}__{m}") for v in values for m in models]
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    g = metrics.groupBy("method").agg(*cells)
    return g.withColumn("position", F.when(place > 0, place).otherwise(len(methods) + 1)).orderBy("position", "method")


def ablation_deltas(scores: DataFrame, by: Sequence[str], values: Sequence[str] = ("hit", "mrr", "ndcg", "first_rank"), pairs: Sequence[tuple[str, str, str]] = ABLATIONS) -> DataFrame:
    """Differences of means, variant minus base; pairs with a missing side are left out.

    Infinite ranks stay in the means, so a difference may be infinite or NaN.
    """
    means = scores.groupBy(*by, "method").agg(*(F.avg(v).alias(v) for v in values))
    spark = scores.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(pairs), "base string, variant string, ablation string"))  # five rows
    b = means.select(*by, F.col("method").alias("base"), *(F.col(v).alias(f"b_{v}") for v in values))
    x = means.select(*by, F.col("method").alias("variant"), *(F.col(v).alias(f"v_{v}") for v in values))
    joined = b.join(wanted, "base").join(x, [*by, "variant"])
    return joined.select(*by, "ablation", "base", "variant", *((F.col(f"v_{v}") - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values))


def starred(means: DataFrame, tests: DataFrame, value: str, baseline: str = "bm25") -> DataFrame:
    """(model_key, method, cell): each mean with the stars of its test against the baseline.

    ``means`` has model_key, method and value; ``tests`` has model_key, method_a, method_b
    and p_value of pairs, in either order.
    """
    from normloom.operators.statistics import stars

    other = F.when(F.col("method_a") == baseline, F.col("method_b")).when(F.col("method_b") == baseline, F.col("method_a"))
    p = tests.select("model_key", other.alias("method"), "p_value").where("method is not null")
    number = F.format_string("%.3f", F.round(F.round(F.col(value), 9), 3))
    return means.join(p, ["model_key", "method"], "left").select("model_key", "method", F.concat(number, F.coalesce(stars(F.col("p_value")), F.lit(""))).alias("cell"))


def old_new_deltas(old: DataFrame, new: DataFrame, values: Sequence[str] = ("hit_rate", "mrr", "ndcg"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows that both tables have, with the differences new minus old."""
    o = old.select(*keys, *(F.col(v).alias(f"{v}_old") for v in values))
    n = new.select(*keys, *(F.col(v).alias(f"{v}_new") for v in values))
    return o.join(n, list(keys)).select("*", *((F.col(f"{v}_new") - F.col(f"{v}_old")).alias(f"delta_{v}") for v in values))


def k_trend(metrics: DataFrame) -> DataFrame:
    """Means over all systems at each k, and the rank of the k by mean NDCG."""
    return ranked_by(global_means(metrics, ["k"]), "mean_ndcg")


def k_winners(metrics: DataFrame) -> DataFrame:
    """Best system at each k by NDCG, whole rows."""
    w = Window.partitionBy("dataset", "level", "k").orderBy(F.round("ndcg", 9).desc(), "model_key", "method")
    return metrics.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("dataset", "level", "k", "model_key", "method", "ndcg")


def same_frames(left: DataFrame, right: DataFrame, digits: int = 12) -> DataFrame:
    """One row: rows of either side that the other lacks, doubles rounded."""
    if left.columns != right.columns:
        raise ValueError("the frames have different columns")
    fix = lambda df: df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    a, b = fix(left), fix(right)
    return a.exceptAll(b).withColumn("_s", F.lit("l")).unionByName(b.exceptAll(a).withColumn("_s", F.lit("r"))).agg(
        F.count_if(F.col("_s") == "l").alias("only_left"), F.count_if(F.col("_s") == "r").alias("only_right")
    )


def missing_steps(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps still to be run."""
    return wanted.join(done, list(keys), "left_anti")


def complete_systems(metrics: DataFrame, expected: Sequence[int] = vocab.K_VALUES) -> DataFrame:
    """(dataset, level, model_key, method, complete): whether all expected k are there."""
    g = metrics.groupBy("dataset", "level", "model_key", "method").agg(F.collect_set(F.col("k").cast("int")).alias("ks"))
    return g.select("dataset", "level", "model_key", "method", (F.size(F.array_except(F.array(*map(F.lit, expected)), "ks")) == 0).alias("complete"))


def text_report(metrics: DataFrame) -> DataFrame:
    """One aligned line per row, numbers with three digits."""
    return metrics.select(
        *KEYS, F.format_string("%-14s %-14s k=%-3d hit=%.3f mrr=%.3f ndcg=%.3f", "model_key", "method", F.col("k").cast("int"), *(F.round(F.round(c, 9), 3) for c in ("hit_rate", "mrr", "ndcg"))).alias("line")
    )


def token_lengths(df: DataFrame, text: str, limit: int) -> DataFrame:
    """(token_limit, max_tokens, mean_tokens, n_over, pct_over) of white-space tokens."""
    from normloom.functions.text import WS

    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"{WS}+"), lambda x: x != ""))
    return df.select(n.alias("n")).agg(
        F.lit(limit).alias("token_limit"), F.max("n").alias("max_tokens"), F.avg("n").alias("mean_tokens"),
        F.count_if(F.col("n") > limit).alias("n_over"), (F.avg((F.col("n") > limit).cast("double")) * 100).alias("pct_over"),
    )


def first_filled_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a group: of each other column the first value in order that is not null,
    which may come from different rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = [c for c in df.columns if c not in by]
    rows = df.select(*by, *(F.first(c, ignorenulls=True).over(w).alias(c) for c in rest), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_n"))
    return rows.where("_n = 1").drop("_n")


def largest_gaps(comparison_rows: DataFrame, n: int = 6) -> DataFrame:
    """The report's head: the n largest gaps between the best and the second model."""
    return comparison_rows.where("num_compared >= 2").orderBy(F.round("gap_to_second", 9).desc(), "dataset", "level", "method", "metric").limit(n)


def known_models(df: DataFrame, known: Sequence[str], column: str = "model_key") -> tuple[DataFrame, list[str]]:
    """Rows of known models, and the asked ones that are not known; none known is an error."""
    asked = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()]  # one row a model
    if not set(asked) & set(known):
        raise ValueError(f"none of the models {sorted(asked)} is known")
    return df.where(F.col(column).isin(*known)), sorted(set(asked) - set(known))


def negative_cases(categories: DataFrame) -> DataFrame:
    """Queries whose relevant documents came late or not at all."""
    return categories.where(F.col("category").isin("late_hit", "complete_miss"))


def _four(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.4f", F.round(F.round(x, 9), 4))


def top_lines(metrics: DataFrame) -> DataFrame:
    """(dataset, level, line): the best system by NDCG of each dataset and level in words."""
    order = [F.round("ndcg", 9).desc_nulls_last(), F.col("model_key"), F.col("method")]
    best = first_filled_rows(metrics.select("dataset", "level", "model_key", "method", "ndcg", "mrr", "hit_rate"), ["dataset", "level"], order)
    line = F.concat(F.concat_ws(" | ", "dataset", "level"), F.lit(": "), F.concat_ws(" + ", "model_key", "method"), F.lit(" (NDCG "), _four("ndcg"), F.lit(", MRR "), _four("mrr"), F.lit(", hit rate "), _four("hit_rate"), F.lit(")"))
    return best.select("dataset", "level", line.alias("line"))


def gap_lines(comparison_rows: DataFrame, n: int = 6) -> DataFrame:
    """(line, gap): the largest gaps in words."""
    line = F.concat(F.concat_ws(" | ", "dataset", "level", "method", "metric"), F.lit(": "), F.col("best_model_key"), F.lit(" leads "), F.col("second_model_key"), F.lit(" by "), _four("gap_to_second"))
    return largest_gaps(comparison_rows, n).select(line.alias("line"), F.col("gap_to_second").alias("gap"))


def method_means(scores: DataFrame, by: Sequence[str] = ("model_key", "method"), values: Sequence[str] = ("hit", "mrr", "ndcg", "first_rank")) -> DataFrame:
    """Means of per-query scores; an infinite rank makes its mean infinite."""
    return scores.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def robustness_lines(means: DataFrame, tests: DataFrame) -> DataFrame:
    """(part, line): the methods' means, and the pairs that differ after Holm's correction."""
    rank = F.when(F.col("first_rank") == float("inf"), "inf").otherwise(F.format_string("%.2f", F.round(F.round("first_rank", 9), 2)))
    a = means.select(F.lit("means").alias("part"), F.concat(F.concat_ws(" ", "model_key", "method"), F.lit(": hit "), _four("hit"), F.lit(", mrr "), _four("mrr"), F.lit(", ndcg "), _four("ndcg"), F.lit(", rank "), rank).alias("line"))
    significant = tests.where("significant_holm_0_05")
    b = significant.select(F.lit("significant").alias("part"), F.concat(F.concat_ws(" ", "model_key", "metric"), F.lit(": "), F.concat_ws(" against ", "method_a", "method_b"), F.lit(", difference "), _four("delta_mean"), F.lit(", p "), _four("p_value_holm"), F.lit(", "), F.col("effect_label")).alias("line"))
    return a.unionByName(b)


def ablation_report(pivot: DataFrame, models: Sequence[str], values: Sequence[str] = ("hit_rate", "mrr", "ndcg"), baselines: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """(position, line): the pivoted table as aligned text under a head; ``baselines`` (name,
    NDCG), such as a random order and the best possible one, go first."""
    columns = [f"{v}__{m}" for v in values for m in models]
    cell = lambda c: F.lpad(F.coalesce(F.format_string("%.3f", F.round(F.round(F.col(c), 9), 3)), F.lit("-")), len(c), " ")
    rows = pivot.select("position", F.concat_ws("  ", F.rpad("method", 16, " "), *map(cell, columns)).alias("line"))
    head = [(-1 - len(baselines), "  ".join(["method".ljust(16), *columns]))] + [(i - len(baselines), f"{name.ljust(16)}  NDCG {value:.3f}") for i, (name, value) in enumerate(baselines)]
    return pivot.sparkSession.createDataFrame(head, "position bigint, line string").unionByName(rows.withColumn("position", F.col("position").cast("bigint")))
