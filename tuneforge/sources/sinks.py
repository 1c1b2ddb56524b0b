"""Sinks: a search is saved as parquet tables in a shared folder (trials, history, summary).

The summary (estimator, task, selection type, attempts, total combinations, best
parameters, best cost, duration) is derived from the written trial table by aggregation,
so it is consistent with what is stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.operators.selection import select_best
from tuneforge.session import ensure_checkpoint_dir


def default_output_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/searches/{uuid.uuid4().hex}"


def save_search(
    spark: SparkSession,
    trials: DataFrame,
    param_names: list[str],
    meta: dict,
    out_dir: str | None = None,
    history: DataFrame | None = None,
) -> tuple[str, DataFrame]:
    """Write ``trials`` (and ``history``) then a one-row summary; returns (folder, summary read back)."""
    out = out_dir or default_output_dir(spark)
    trials.write.mode("overwrite").parquet(f"{out}/trials")
    if history is not None:
        history.write.mode("overwrite").parquet(f"{out}/history")
    written = spark.read.parquet(f"{out}/trials")
    best = select_best(written.select("trial_id", *param_names, "cost"))
    summary = best.select(
        F.lit(str(meta.get("estimator"))).alias("estimator"),
        F.lit(str(meta.get("task"))).alias("task"),
        F.lit(str(meta.get("selection_type"))).alias("selection_type"),
        F.lit(int(meta.get("attempts", 0))).cast("bigint").alias("attempts"),
        F.lit(int(meta.get("total_combinations", 0))).cast("bigint").alias("total_combinations"),
        *[F.col(p) for p in param_names],
        F.round("cost", 4).alias("best_cost"),
        F.lit(float(meta.get("duration", 0.0))).alias("duration"),
    )
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    return out, spark.read.parquet(f"{out}/summary")
