"""Selection over trial tables ``(trial_id, ..., cost, status)``: best, leaderboard, failures, trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_best(trials: DataFrame, group: list[str] | None = None) -> DataFrame:
    """First strict minimum: order by ``(cost, trial_id)``; NULL (failed) costs never win.
    One partial+final aggregate of ``min(struct(cost, trial_id, row))``."""
    payload = [c for c in trials.columns if c not in ("cost", "trial_id") and c not in (group or [])]
    s = F.struct(F.col("cost").alias("cost"), F.col("trial_id").alias("trial_id"), *[F.col(c) for c in payload])
    g = trials.filter(F.col("cost").isNotNull())
    agg = g.groupBy(*(group or [])).agg(F.min(s).alias("_b"))
    return agg.select(*(group or []), "_b.*")


def leaderboard(trials: DataFrame, k: int) -> DataFrame:
    """The ``k`` best trials (a top-k report: TakeOrderedAndProject, no global sort)."""
    ranked = trials.filter(F.col("cost").isNotNull()).orderBy(F.col("cost").asc(), F.col("trial_id").asc()).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cost").asc(), F.col("trial_id").asc())))


def mark_failed(trials: DataFrame, valid: Column | None = None, reason: Column | None = None) -> DataFrame:
    """``status``/``error``: failed when the candidate is invalid for the data or its cost is not finite."""
    bad_cost = F.col("cost").isNull() | F.isnan("cost") | (F.abs(F.col("cost")) == F.lit(float("inf")))
    invalid = F.lit(False) if valid is None else ~F.coalesce(valid, F.lit(False))
    status = F.when(invalid | bad_cost, F.lit("failed")).otherwise(F.lit("ok"))
    err = (
        F.when(invalid, reason if reason is not None else F.lit("invalid candidate"))
        .when(bad_cost, F.lit("non-finite cost"))
    )
    return trials.withColumn("status", status).withColumn("error", err).withColumn(
        "cost", F.when(status == "ok", F.col("cost"))
    )


def running_best(trace: DataFrame, order: str = "iteration", group: list[str] | None = None) -> DataFrame:
    """Best cost so far per iteration: per-iteration minima (small) then a running min."""
    per = trace.groupBy(*(group or []), order).agg(F.min("cost").alias("iter_best"))
    w = Window.partitionBy(*(group or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("best_so_far", F.min("iter_best").over(w))
