"""Search drivers: grid, random and particle-swarm search over a candidate table.

The driver loop only sequences jobs; all data work happens in the fitness function, which
scores a whole batch of candidates in shared passes over the training rows. Iterative
state (the swarm) is reliably checkpointed every iteration, so a lost executor never
replays the whole search.
"""

from __future__ import annotations

import os
import sys
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tuneforge.operators import swarm as sw
from tuneforge.operators.candidates import decode_candidates, grid_enumerate, random_candidates
from tuneforge.operators.linear import collect_batch, linear_scores
from tuneforge.operators.scoring import rmse_cost
from tuneforge.operators.space import SearchSpace
from tuneforge.session import cut_lineage, ensure_checkpoint_dir, materialize

Fitness = Callable[[DataFrame], DataFrame]


def linear_fitness(rows: DataFrame, features: list, weights: list[str], split: str | None = "val",
                   intercept: str | None = None, cost_fn=None) -> Fitness:
    """Fitness of the linear scorer: cost (RMSE by default) of ``sum w_i x_i`` on ``split`` rows."""
    src = rows if split is None else rows.filter(F.col("split") == split)
    feats = [F.col(f) if isinstance(f, str) else f for f in features]
    src = src.select("key", "label", "split", *[f.alias(f"_in{i}") for i, f in enumerate(feats)])
    cache: dict = {}
    lock = Lock()

    def fit(cands: DataFrame) -> DataFrame:
        with lock:
            if "rows" not in cache:   # scanned once per search, then read from the checkpoint
                cache["rows"] = materialize(src)
        fields = list(weights) + ([intercept] if intercept else [])
        batch = collect_batch(cands, fields)
        scores = linear_scores(cache["rows"], batch, [f"_in{i}" for i in range(len(feats))], weights, intercept)
        if cost_fn is not None:
            return cost_fn(scores)
        return rmse_cost(scores, ["trial_id"])

    return fit


STATUS = ["cost", "status", "error"]


def evaluated(fitness: Fitness, cands: DataFrame) -> DataFrame:
    """``(trial_id, cost, status, error)`` of a batch: what the fitness returns, with the status
    and error of a missing or non-finite cost where it gives none."""
    costs = fitness(cands)
    cost = sw.clean_cost(F.col("cost"))
    status = F.when(cost.isNull(), F.lit("failed")).otherwise(F.lit("ok"))
    own = [F.coalesce(F.col(c), F.lit(None).cast("string")) if c in costs.columns else F.lit(None).cast("string") for c in STATUS[1:]]
    reason = F.when(cost.isNull(), F.coalesce(own[1], F.lit("no finite cost")))
    return costs.select("trial_id", cost.alias("cost"), F.when(cost.isNull(), F.lit("failed")).otherwise(F.coalesce(own[0], status)).alias("status"), reason.alias("error"))


#: Chunks of candidates whose jobs run side by side.
IN_FLIGHT = 2


def evaluate_in_chunks(fitness: Fitness, cands: DataFrame, n_ids: int, chunk: int, in_flight: int = IN_FLIGHT) -> DataFrame:
    """Evaluate candidates with trial ids below ``n_ids``, ``chunk`` ids at a time, into written
    tables: a batch on the driver never exceeds ``chunk`` candidates.

    Chunks depend on nothing but the rows, so up to ``in_flight`` of them run at once, each in its own
    scheduler pool (they share the cores evenly if ``spark.scheduler.mode`` is FAIR): while one waits for
    its last tasks, another's fill the cores. The first error ends the search."""
    spark = cands.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trials/{uuid.uuid4().hex}"
    starts = list(range(0, n_ids, chunk))

    def one(start: int) -> str:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"chunks-{start // chunk % in_flight}")
        try:
            batch = cands.filter((F.col("trial_id") >= start) & (F.col("trial_id") < start + chunk))
            own = f"{path}/{start}"
            evaluated(fitness, batch).write.parquet(own)
            return own
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if in_flight < 2 or len(starts) < 2:
        paths = [one(s) for s in starts]
    else:
        with ThreadPoolExecutor(in_flight) as pool:
            waiting = [pool.submit(inheritable_thread_target(spark)(one), s) for s in starts]
            try:
                paths = [f.result() for f in waiting]
            except BaseException:
                pool.shutdown(wait=False, cancel_futures=True)
                raise
    return spark.read.parquet(*paths)


@dataclass
class SearchResult:
    trials: DataFrame
    total_combinations: int
    attempts: int
    duration: float
    history: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def _param_cols(space: SearchSpace):
    return [F.col(f"params.{n}").alias(n) for n in space.names]


def search_grid(spark: SparkSession, space: SearchSpace, fitness: Fitness, chunk: int = 256) -> SearchResult:
    """Every grid point, fitted in chunks of ``chunk`` candidates per pass over the rows.
    All chunks append to one written trial table."""
    t0 = time.time()
    total = space.total
    grid = decode_candidates(grid_enumerate(spark, space), space, with_defaults=False)
    costs = evaluate_in_chunks(fitness, grid, total, chunk)
    trials = cut_lineage(grid.join(costs, "trial_id", "left").select("trial_id", "pos", *_param_cols(space), *STATUS))
    return SearchResult(trials, total, total, time.time() - t0)


def search_random(spark: SparkSession, space: SearchSpace, fitness: Fitness, n_attempts: int = 20, seed: int = 0, chunk: int = 256) -> SearchResult:
    """``n_attempts`` grid points drawn uniformly with replacement; duplicates fitted once."""
    t0 = time.time()
    rc = decode_candidates(random_candidates(spark, space, seed=seed, n=n_attempts), space, with_defaults=False)
    uniq = cut_lineage(rc.groupBy("params").agg(F.min("trial_id").alias("trial_id")))
    costs = uniq.join(evaluate_in_chunks(fitness, uniq, n_attempts, chunk), "trial_id", "left").select("params", *STATUS)
    trials = cut_lineage(rc.join(costs, "params", "left").select("trial_id", "grid_index", "pos", *_param_cols(space), *STATUS))
    return SearchResult(trials, space.total, n_attempts, time.time() - t0)


def search_pso(
    spark: SparkSession,
    space: SearchSpace,
    fitness: Fitness,
    n_particles: int = 5,
    iterations: int = 10,
    options: dict | None = None,
    psotype: str = "global",
    k: int | None = None,
    p: float = 2.0,
    seed: int = 0,
    boundary: str = "periodic",
    elite: bool = False,
    chunk: int = 256,
) -> SearchResult:
    """Particle swarm search; ``psotype`` 'global' (star) or 'local' (k nearest, p-norm).

    Returns the per-iteration trace as ``trials`` (iteration, pid, x, params, cost,
    pbest_cost, best_cost, best_x) and the history of best costs.
    """
    if psotype not in ("global", "local"):
        raise ValueError(f"unknown psotype {psotype!r}")
    t0 = time.time()
    k = min(3, n_particles) if k is None else k
    state = sw.swarm_init(spark, space, n_particles, seed)
    elite_tbl = None
    snaps, evaluations = [], []

    def fit_swarm(cands: DataFrame) -> DataFrame:
        found = evaluate_in_chunks(fitness, cut_lineage(cands), n_particles, chunk)
        evaluations.append(found.withColumn("iteration", F.lit(len(evaluations))))
        return found.select("trial_id", "cost")

    start = sw.swarm_init(spark, space, n_particles, seed).select("pid", "x", "v")
    for it in range(iterations):
        state = sw.swarm_evaluate(state, space, fit_swarm)
        if elite:
            state, elite_tbl = sw.elite_retention(state, space, elite_tbl)
            raw = state.select("pid", "raw_cost")
            state = state.drop("raw_cost")
        state = sw.personal_best(state)
        state = sw.global_best(state)
        if psotype == "local":
            state = sw.local_best(state, k, p)
        _t = time.time()
        if elite:
            state = state.join(raw, "pid")
            elite_tbl = cut_lineage(elite_tbl)
        state = cut_lineage(state)
        if os.environ.get("TUNEFORGE_VERBOSE"):
            print(f"[pso] iteration {it} bookkeeping+checkpoint {time.time() - _t:.2f}s", file=sys.stderr)
        snap = state.select(
            F.lit(it).alias("iteration"), "pid", "x", sw.params_struct(space, F.col("x"), False).alias("params"),
            "cost", "pbest_cost", F.col("gbest_cost").alias("best_cost"), F.col("gbest_x").alias("best_x"),
            *(["raw_cost"] if elite else []),
        )
        snaps.append(snap)
        if elite:
            state = state.drop("raw_cost")
        state = sw.swarm_move(state, space, it, seed, options, boundary)
    trials = snaps[0]
    for s in snaps[1:]:
        trials = trials.unionByName(s)
    history = trials.groupBy("iteration").agg(F.min("best_cost").alias("best_cost"))
    return SearchResult(trials, space.total, n_particles * iterations, time.time() - t0, history,
                        {"n_particles": n_particles, "iterations": iterations, "psotype": psotype, "options": dict(options or {}),
                         "k": k, "p": p, "seed": seed, "boundary": boundary, "initial": start,
                         "evaluations": reduce(DataFrame.unionByName, evaluations)})
