"""Built-in estimators registered with the registry: batched fits behind one signature.

``fit_batch(spark, data, cands, task, score, options) -> DataFrame(trial_id, cost, status, error)``
where ``data`` is a :class:`PreparedData` and ``cands`` a bounded list of decoded parameter
dicts (with ``trial_id``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.operators import trees
from tuneforge.operators.packed import packed_rows
from tuneforge.operators.space import DEFAULT_PARAMS, DEFAULT_SPACES
from tuneforge.plans import model
from tuneforge.plans.registry import register_estimator
from tuneforge.session import materialize


@dataclass
class PreparedData:
    """Rows ``(key, features ARRAY<DOUBLE>, label, split)``; split in train / val / test."""

    rows: DataFrame
    n_features: int
    _binned: dict = field(default_factory=dict)
    _folded: dict = field(default_factory=dict)
    _lock: object = field(default_factory=Lock, repr=False)

    def binned(self, n_bins: int = 32, method: str = "quantile"):
        k = (n_bins, method)
        with self._lock:  # chunks of a search may ask at once
            if k not in self._binned:
                b = trees.fit_binning(self.rows, self.n_features, n_bins, method, fit_filter=F.col("split") == "train")
                # written once for all batches and iterations of a search
                self._binned[k] = (materialize(trees.apply_binning(self.rows, b, self.n_features)), b)
            return self._binned[k]

    def folded(self, folds: int, seed: int) -> DataFrame:
        """Training rows ``(features, label, fold)`` in blocks, written once for all steps of all batches."""
        from tuneforge.operators import kernels, svm

        k = (folds, seed)
        with self._lock:
            if k not in self._folded:
                fold = svm.fold_of(folds, seed) if folds else F.lit(0)
                self._folded[k] = kernels.packed_folds(self.rows.filter(F.col("split") == "train").select("features", "label", fold.alias("fold")), self.n_features)
            return self._folded[k]

    def held_out(self) -> DataFrame:
        """Validation rows ``(features, label)`` in blocks, written once."""
        with self._lock:
            if "val" not in self._folded:
                self._folded["val"] = packed_rows(self.rows.filter(F.col("split") == "val"), self.n_features, ("label",))
            return self._folded["val"]


def _space(est):
    return lambda task: dict(DEFAULT_SPACES.get((est, task)) or DEFAULT_SPACES[(est, None)])


def _params(est):
    return lambda task: dict(DEFAULT_PARAMS.get((est, task)) or DEFAULT_PARAMS[(est, None)])


#: Leaves of a tree that grows best-first (the public default of that library).
MAX_LEAVES = 31


def boost_config(options: dict | None, default_stop: int | None, default_leaves: int | None = None) -> trees.BoostConfig:
    o = dict(options or {})
    return trees.BoostConfig(
        max_leaves=o.get("max_leaves", default_leaves),
        n_bins=o.get("n_bins", 32), binning=o.get("binning", "quantile"), seed=o.get("seed", 0),
        early_stopping_rounds=o.get("early_stopping_rounds", default_stop), checkpoint_every=o.get("checkpoint_every", 4),
    )


def _fit_trees(default_stop, default_leaves=None):
    def fit(spark: SparkSession, data: PreparedData, cands: list[dict], task: str, score: str, options: dict | None = None) -> DataFrame:
        cfg = boost_config(options, default_stop, default_leaves)
        binned, binning = data.binned(cfg.n_bins, cfg.binning)
        return trees.fit_boosted_trees(spark, binned, cands, score, cfg, binning).costs.select("trial_id", "cost", "status", "error")

    return fit


# xgboost: level-wise, no early stopping by default (the reference stopped passing it); gbdt: best-first, patience 20
register_estimator("xgboost", _space("xgboost"), _params("xgboost"), _fit_trees(None), model.fit_booster(None))
register_estimator("gbdt", _space("gbdt"), _params("gbdt"), _fit_trees(20, MAX_LEAVES), model.fit_booster(20, MAX_LEAVES))


# ---------------------------------------------------------------- svm
def _fit_svm(spark: SparkSession, data: PreparedData, cands: list[dict], task: str, score: str, options: dict | None = None) -> DataFrame:
    """The whole batch, of whatever kernels, gammas, degrees and C, is fitted in shared passes: one job
    a step. Missing ``degree`` for poly defaults to 3."""
    from tuneforge.operators import kernels, scoring

    o = dict(options or {})
    kind = "svc" if task == "binary classification" else "svr"
    maps, results, good = model.svm_maps(data.n_features, o), [], []
    for c in cands:
        if c.get("kernel", "rbf") not in kernels.KERNELS:
            results.append((c["trial_id"], None, "failed", f"unknown kernel {c['kernel']!r}"))
        elif not (c.get("C") and float(c["C"]) > 0):
            results.append((c["trial_id"], None, "failed", "C must be > 0"))
        else:
            good.append(c)
    if good:
        # probabilities are scaled on training rows that their model has not seen
        folds = o.get("platt_folds", 3) if score == "auc" else 0
        train = data.folded(folds, maps.seed)
        fits = kernels.fit_steps(train, kernels.new_fits(good, maps, folds), maps, o.get("n_steps", 20), o.get("lr", 0.5), kind)
        fitted = [f for f in fits if f.held_out < 0]
        if score in ("rmse", "acc"):
            cost = kernels.batch_costs(data.held_out(), fitted, maps, score)
        else:
            sc = kernels.batch_scores(data.rows.filter(F.col("split") == "val"), fitted, maps)
            ab = kernels.platt_steps(train, fits, maps, o.get("platt_steps", 10))
            pmap = F.create_map(*[x for t, (a, b) in ab.items() for x in (F.lit(t), F.struct(F.lit(a).alias("A"), F.lit(b).alias("B")))])
            pr = sc.withColumn("_ab", F.element_at(pmap, F.col("trial_id"))).withColumn(
                "score", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_ab.A") * F.col("score") + F.col("_ab.B"))))
            cost = {r["trial_id"]: r["cost"] for r in scoring.auc_cost(pr, ["trial_id"]).collect()}
        results += [(t, c, "ok", None) for t, c in cost.items()]
    return spark.createDataFrame(results, "trial_id bigint, cost double, status string, error string")


register_estimator("svm", _space("svm"), _params("svm"), _fit_svm, model.fit_svm)


# ---------------------------------------------------------------- mlp
def _fit_mlp(spark: SparkSession, data: PreparedData, cands: list[dict], task: str, score: str, options: dict | None = None) -> DataFrame:
    from tuneforge.operators import mlp, scoring

    o = dict(options or {})
    weights, _, errors = mlp.fit_mlp(data.rows, cands, data.n_features, seed=o.get("seed", 0), epochs=o.get("epochs"),
                                     patience=o.get("early_stopping_rounds", 20), n_shards=o.get("n_shards"))
    results = [(tid, None, "failed", e) for tid, e in errors.items()]
    if weights:
        sc = mlp.predict_scores(data.rows, weights, cands, data.n_features)
        if score == "rmse":
            cost = scoring.rmse_cost(sc, ["trial_id"])
        elif score == "acc":
            cost = scoring.accuracy_cost(sc.withColumn("pred_label", scoring.rounded_label(F.col("score"))), ["trial_id"])
        else:
            cost = scoring.auc_cost(sc, ["trial_id"])
        for r in cost.collect():
            bad = r["cost"] is None or r["cost"] != r["cost"]
            results.append((r["trial_id"], None if bad else r["cost"], "failed" if bad else "ok", "non-finite cost" if bad else None))
    return spark.createDataFrame(results, "trial_id bigint, cost double, status string, error string")


register_estimator("mlp", _space("mlp"), _params("mlp"), _fit_mlp, model.fit_network)
