"""Validation scores, grouped by candidate. Every score is a cost (lower is better).

``pred`` tables are long: ``(*group, label, score)`` with one row per (candidate, row).
RMSE and accuracy are single hash aggregates with map-side partial aggregation. AUC and
ROC are exact (ties get half credit), computed without a window over a whole candidate:
rows collapse to distinct scores first (so a hot score is one row), distinct scores are
cut into quantile buckets, prefix sums run over bucket totals and then only inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneforge.session import cut_lineage


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rmse_cost(pred: DataFrame, group: list[str], label: str = "label", score: str = "score", alias: str = "cost") -> DataFrame:
    return pred.groupBy(*group).agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(score), 2))).alias(alias))


def accuracy_cost(pred: DataFrame, group: list[str], label: str = "label", pred_label: str = "pred_label", alias: str = "cost") -> DataFrame:
    """``1 - accuracy`` where ``pred_label`` is already a class label."""
    hit = (F.col(label) == F.col(pred_label)).cast("double")
    return pred.groupBy(*group).agg((F.lit(1.0) - F.avg(hit)).alias(alias))


def threshold_label(score: Column, threshold: float = 0.5) -> Column:
    """Class label of a probability (``predict`` of a probabilistic classifier)."""
    return F.when(score > F.lit(threshold), F.lit(1.0)).otherwise(F.lit(0.0))


def rounded_label(score: Column) -> Column:
    """``np.round`` of a raw network output: half-to-even, 0.5 -> 0, values outside {0,1} stay wrong."""
    return F.bround(score, 0)


def _distinct_scores(pred: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    rows = F.col("n_rows") if "n_rows" in pred.columns else F.lit(1)  # equal rows may come as one with their number
    return pred.groupBy(*group, score).agg(
        F.sum(F.when(F.col(label) == 1, rows).otherwise(0)).cast("long").alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(rows)).cast("long").alias("_neg"),
    )


def _below_counts(pred: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """Distinct-score table with ``_pos_below``/``_neg_below`` = counts at strictly lower scores.

    Distinct scores are range-partitioned by (group, score) and written once; a partition is a
    bucket, so buckets grow in number with the data and not in size. Prefix sums run over the
    bucket totals (a row for each partition and group) and then inside a bucket only."""
    if not group:
        raise ValueError("group by at least one column (e.g. trial_id)")
    d = _distinct_scores(pred, group, label, score).repartitionByRange(*group, score)
    d = cut_lineage(d.withColumn("_bucket", F.spark_partition_id()))
    bt = d.groupBy(*group, "_bucket").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    all_ = Window.partitionBy(*group)
    wb = all_.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(
        *group, "_bucket", F.sum("_bp").over(all_).alias("_P"), F.sum("_bn").over(all_).alias("_N"),
        F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_bp_before"),
        F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_bn_before"),
    )
    # bucket totals: at most partitions + groups rows
    d = d.join(F.broadcast(bt), group + ["_bucket"], "inner")
    wi = Window.partitionBy(*group, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(
        *group, score, "_pos", "_neg", "_P", "_N",
        (F.col("_bp_before") + F.coalesce(F.sum("_pos").over(wi), F.lit(0))).alias("_pos_below"),
        (F.col("_bn_before") + F.coalesce(F.sum("_neg").over(wi), F.lit(0))).alias("_neg_below"),
    )


def auc_value(pred: DataFrame, group: list[str], label: str = "label", score: str = "score", alias: str = "auc") -> DataFrame:
    """Exact ROC AUC per group (trapezoid area = Mann-Whitney with half credit for ties)."""
    b = _below_counts(pred, group, label, score)
    contrib = F.col("_pos").cast("double") * (F.col("_neg_below").cast("double") + F.lit(0.5) * F.col("_neg").cast("double"))
    out = b.groupBy(*group).agg(F.sum(contrib).alias("_num"), F.first("_P").alias("_P"), F.first("_N").alias("_N"))
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_num") / (F.col("_P").cast("double") * F.col("_N").cast("double")))
    return out.select(*group, auc.alias(alias))


def auc_cost(pred: DataFrame, group: list[str], label: str = "label", score: str = "score", alias: str = "cost") -> DataFrame:
    a = auc_value(pred, group, label, score, "_auc")
    return a.select(*group, (F.lit(1.0) - F.col("_auc")).alias(alias))


def roc_curve(pred: DataFrame, group: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """One row per (group, distinct score threshold): ``fpr``, ``tpr`` of the rule ``score >= threshold``."""
    b = _below_counts(pred, group, label, score)
    tp = F.col("_P") - F.col("_pos_below")
    fp = F.col("_N") - F.col("_neg_below")
    return b.select(
        *group,
        F.col(score).alias("threshold"),
        (fp.cast("double") / F.col("_N").cast("double")).alias("fpr"),
        (tp.cast("double") / F.col("_P").cast("double")).alias("tpr"),
    )
