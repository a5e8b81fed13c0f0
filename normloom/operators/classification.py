"""Classification metrics from one confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions import vocab


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = vocab.LABELS) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of the given labels, zeros included; rows with
    other or missing labels are left out."""
    counts = df.where(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)).groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "y_true string, y_pred string")
    return grid.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def _per_label(cells: DataFrame) -> DataFrame:
    """(label, tp, support, predicted, precision, recall, f1) from one pass of the cells; a zero divisor gives 0."""
    flat = cells.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
    )))
    g = flat.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return g.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def per_class(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support)."""
    return _per_label(cells).select("label", "precision", "recall", "f1", "support")


def summary(cells: DataFrame) -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1, cohen_kappa, n.  Macro is over all given labels.

    All of it follows from the labels' sums: agreement is the sum of tp, chance that of
    support times predicted.
    """
    one = _per_label(cells).agg(
        F.sum("tp").alias("same"),
        F.sum("support").alias("n"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("ab"),
    )
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.col("ab"), F.col("n").cast("double") * F.col("n"))
    return one.select(po.alias("accuracy"), "macro_f1", "weighted_f1", F.try_divide(po - pe, 1 - pe).alias("cohen_kappa"), "n")


def confusion_matrix(cells: DataFrame, labels: Sequence[str] = vocab.LABELS) -> DataFrame:
    """One row per true label, one column per predicted label (blanks as underscores)."""
    sums = [F.sum(F.when(F.col("y_pred") == x, F.col("n")).otherwise(0)).alias(x.lower().replace(" ", "_")) for x in labels]
    return cells.groupBy("y_true").agg(*sums)
