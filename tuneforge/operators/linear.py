"""Linear scorer: the smallest estimator (prediction ``sum_i w_i * x_i + c``).

It is the fixture fitness of the swarm / grid / random drivers and the model behind the
scoring operators' tests. A candidate batch (bounded size, checked) is inlined as a
literal array and exploded per row, so a batch is scored in one pass with no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BATCH = 4096


def candidate_literal(cands: list[dict], fields: list[str]):
    if len(cands) > MAX_BATCH:
        raise ValueError(f"candidate batch of {len(cands)} exceeds {MAX_BATCH}; split it into chunks")
    return F.array(*[
        F.struct(F.lit(c["trial_id"]).alias("trial_id"), *[F.lit(float(c[f])).cast("double").alias(f) for f in fields])
        for c in cands
    ])


def linear_scores(
    rows: DataFrame,
    cands: list[dict],
    features: list,
    weights: list[str],
    intercept: str | None = None,
    keep: tuple[str, ...] = ("key", "label", "split"),
) -> DataFrame:
    """``(trial_id, *keep, score)`` for every (candidate, row)."""
    fields = list(weights) + ([intercept] if intercept else [])
    lit = candidate_literal(cands, fields)
    feats = [F.col(f) if isinstance(f, str) else f for f in features]
    base = rows.select(*keep, *[f.alias(f"_x{i}") for i, f in enumerate(feats)])
    ex = base.select(*keep, *[f"_x{i}" for i in range(len(feats))], F.explode(lit).alias("_c"))
    score = None
    for i, w in enumerate(weights):
        term = F.col(f"_c.{w}") * F.col(f"_x{i}")
        score = term if score is None else score + term
    if intercept:
        score = score + F.col(f"_c.{intercept}")
    return ex.select(F.col("_c.trial_id").alias("trial_id"), *keep, score.alias("score"))


def collect_batch(candidates: DataFrame, fields: list[str]) -> list[dict]:
    """Bring a bounded candidate batch (not data rows) to the driver for inlining."""
    # callers build batches bounded by construction (trial-id chunks, n_particles); checked here
    rows = candidates.select("trial_id", *[F.col(f"params.{f}").alias(f) for f in fields]).limit(MAX_BATCH + 1).collect()
    if len(rows) > MAX_BATCH:
        raise ValueError(f"candidate batch exceeds {MAX_BATCH}; split it into chunks")
    return [r.asDict() for r in rows]
