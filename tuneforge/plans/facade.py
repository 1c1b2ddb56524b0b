"""``HyperSearch``: the user-facing facade (estimator, task, score, search space) whose
methods run grid / random / particle-swarm searches and return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tuneforge.plans.estimators  # noqa: F401  (registers the built-in estimators)
from tuneforge.operators import selection
from tuneforge.operators.space import SearchSpace, validate
from tuneforge.plans import search
from tuneforge.plans.estimators import PreparedData
from tuneforge.plans.failures import fit_or_bisect
from tuneforge.plans.registry import get_estimator
from tuneforge.session import materialize
from tuneforge.sources.features import load_features

MAX_CHUNK = 64      # candidates fitted together per pass over the rows (grid search chunks)
MAX_BATCH = 4096    # hard bound on a batch brought to the driver
SWARM_IDS = 10 ** 12    # a swarm's trial id is iteration * SWARM_IDS + particle


class HyperSearch:
    def __init__(self, spark: SparkSession, estimator: str = "xgboost", params: dict | None = None,
                 task: str = "regression", score: str = "rmse", options: dict | None = None):
        validate(estimator, task, score)
        self.spark, self.estimator, self.task, self.score = spark, estimator, task, score
        est = get_estimator(estimator)
        self.space = SearchSpace.from_dict(params or est.default_space(task), est.default_params(task))
        self.options = dict(options or {})
        self._est = est

    @staticmethod
    def prepare(df: DataFrame, feature_cols: list[str], label_col: str, key_col: str = "key", split_col: str = "split") -> PreparedData:
        rows = load_features(df.withColumnRenamed(split_col, "split") if split_col != "split" else df, feature_cols, label_col, key_col)
        # scanned by every fit of the search: computed once, partitioned, checkpointed
        return PreparedData(materialize(rows), len(feature_cols))

    def fitness(self, data: PreparedData):
        """Candidate table ``(trial_id, params)`` -> ``(trial_id, cost, status, error)`` via the estimator's
        batched fit. A model's own error fails its trial; errors of data and cluster end the search."""

        def fit(cands: DataFrame) -> DataFrame:
            batch = [self._candidate(r["trial_id"], r["params"].asDict()) for r in cands.select("trial_id", "params").limit(MAX_BATCH + 1).collect()]
            if len(batch) > MAX_BATCH:
                raise ValueError(f"candidate batch exceeds {MAX_BATCH}; use a smaller chunk")
            rows = fit_or_bisect(run, batch) if batch else []
            return self.spark.createDataFrame(rows, "trial_id bigint, cost double, status string, error string")

        def run(some: list[dict]) -> list[tuple]:
            # a row for each candidate of the batch: collected here, so that its errors are met here
            found = self._est.fit_batch(self.spark, data, some, self.task, self.score, self.options)
            return [tuple(r) for r in found.select("trial_id", "cost", "status", "error").collect()]

        return fit

    def _candidate(self, trial_id: int, params: dict) -> dict:
        return dict(self.space.defaults, **params, trial_id=trial_id)

    def best_model(self, data: PreparedData, result: search.SearchResult):
        """The winner's :class:`FittedModel`: fitted as in the search, from its trial row (same rows,
        seed and trial id). It predicts, scores a hold-out, holds the training history, and is saved."""
        if self._est.fit_model is None:
            raise ValueError(f"estimator {self.estimator!r} has no fit_model")
        best = selection.select_best(self._flat_trials(result)).first()
        if best is None:
            raise ValueError("no trial has a finite cost")
        cand = self._candidate(best["trial_id"] % SWARM_IDS, {n: best[n] for n in self.space.names})
        model = self._est.fit_model(self.spark, data, cand, self.task, self.score, self.options)
        model.estimator = self.estimator
        return model

    def fit_grid(self, data: PreparedData, chunk: int = MAX_CHUNK) -> search.SearchResult:
        res = search.search_grid(self.spark, self.space, self.fitness(data), chunk=chunk)
        res.extra["selection_type"] = "Grid"
        return res

    def fit_random(self, data: PreparedData, n_attempts: int = 20, seed: int = 0) -> search.SearchResult:
        res = search.search_random(self.spark, self.space, self.fitness(data), n_attempts, seed, MAX_CHUNK)
        res.extra["selection_type"] = "Random"
        return res

    def fit_pso(self, data: PreparedData, psotype: str = "global", n_particles: int = 5, n_iterations: int = 10,
                options: dict | None = None, seed: int = 0, **kw) -> search.SearchResult:
        """Particle swarm search. Elite retention is on by default for the (stochastic) mlp."""
        kw.setdefault("elite", self.estimator == "mlp")
        kw.setdefault("chunk", MAX_CHUNK)
        res = search.search_pso(self.spark, self.space, self.fitness(data), n_particles, n_iterations, options,
                                psotype, seed=seed, **kw)
        res.extra["selection_type"] = "PSO"
        return res

    def best(self, result: search.SearchResult) -> DataFrame:
        t = result.trials
        cols = [c for c in t.columns if c not in ("pos", "x", "best_x")]
        if "trial_id" not in t.columns:
            t = t.withColumn("trial_id", F.col("iteration").cast("long") * F.lit(SWARM_IDS) + F.col("pid"))
            cols = cols + ["trial_id"]
        return selection.select_best(t.select(*cols))

    def _flat_trials(self, result: search.SearchResult) -> DataFrame:
        t = result.trials
        if "params" in t.columns:   # swarm trace: one trial per (iteration, particle)
            t = t.select(*[c for c in t.columns if c not in ("params", "x", "best_x", "best_cost", "pbest_cost", "raw_cost")],
                         *[F.col(f"params.{n}").alias(n) for n in self.space.names])
            t = t.withColumn("trial_id", F.col("iteration").cast("long") * F.lit(SWARM_IDS) + F.col("pid"))
        more = [c for c in ("status", "error") if c in t.columns]
        return t.select("trial_id", *self.space.names, "cost", *more)

    def save(self, result: search.SearchResult, out_dir: str | None = None):
        """Write trials (+ swarm history) and a one-row summary as parquet; returns (folder, summary)."""
        from tuneforge.sources.sinks import save_search

        meta = {"estimator": self.estimator, "task": self.task, "selection_type": result.extra.get("selection_type"),
                "attempts": result.attempts, "total_combinations": result.total_combinations, "duration": result.duration}
        return save_search(self.spark, self._flat_trials(result), self.space.names, meta, out_dir, result.history)

    def summary(self, result: search.SearchResult) -> DataFrame:
        """Estimator, task, selection type, attempts, total combinations, best parameters, best cost
        (4 decimals) and duration as a one-row DataFrame (derived from the trial table)."""
        best = selection.select_best(self._flat_trials(result))
        return best.select(
            F.lit(self.estimator).alias("estimator"), F.lit(self.task).alias("task"),
            F.lit(str(result.extra.get("selection_type"))).alias("selection_type"),
            F.lit(int(result.attempts)).cast("bigint").alias("attempts"),
            F.lit(int(result.total_combinations)).cast("bigint").alias("total_combinations"),
            *self.space.names, F.round("cost", 4).alias("best_cost"), F.lit(float(result.duration)).alias("duration"),
        )
