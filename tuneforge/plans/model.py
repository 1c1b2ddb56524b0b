"""Fitted models: the winner of a search as an object that predicts, scores, and is saved.

A fit depends on the rows, the decoded parameters, the seed and the trial id alone (never on
the batch it was fitted in), so the winner's model is fitted again from its trial row; searches
keep no models of the other candidates.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.operators import kernels, mlp, scoring, trees


@dataclass
class FittedModel:
    """``payload`` is plain data: everything that scoring raw rows needs."""

    estimator: str
    task: str
    params: dict
    n_features: int
    payload: dict
    history: list = field(default_factory=list)

    def scores(self, rows: DataFrame) -> DataFrame:
        """``(key, label, split, score, decision)`` of rows ``(key, features, label, split)``; for
        classification the score is a probability (mlp: the network's output). The decision is
        what classes are told by: a support vector model's own value, else the score."""
        scored = _SCORERS[self.payload["kind"]](self, rows)
        if "decision" not in scored.columns:
            scored = scored.withColumn("decision", F.col("score"))
        return scored.select("key", "label", "split", "score", "decision")

    def _class(self):
        kind, decision = self.payload["kind"], F.col("decision")
        if kind == "svm":
            return F.when(decision > 0, 1.0).otherwise(0.0)
        return scoring.rounded_label(decision) if kind == "mlp" else scoring.threshold_label(decision)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``(key, prediction)``: a value, or a class 0/1."""
        scored = self.scores(rows)
        if self.task == "binary classification":
            return scored.select("key", self._class().alias("prediction"))
        return scored.select("key", F.col("score").alias("prediction"))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        if self.task != "binary classification":
            raise ValueError("probabilities need a classification task")
        return self.scores(rows).select("key", F.col("score").alias("proba"))

    def score_holdout(self, rows: DataFrame, score: str, split: str = "test") -> float:
        """The cost (rmse, 1 - accuracy or 1 - auc) on a split."""
        s = self.scores(rows.filter(F.col("split") == split)).withColumn("trial_id", F.lit(0))
        if score == "rmse":
            cost = scoring.rmse_cost(s, ["trial_id"])
        elif score == "acc":
            cost = scoring.accuracy_cost(s.withColumn("pred_label", self._class()), ["trial_id"])
        else:
            cost = scoring.auc_cost(s, ["trial_id"])
        return cost.first()["cost"]

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON as a parquet table, in any folder that Spark can write."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        return FittedModel(**json.loads(spark.read.parquet(path).first()["model"]))


# ---------------------------------------------------------------- boosters
def fit_booster(default_stop: int | None, default_leaves: int | None = None):
    def fit(spark, data, cand: dict, task: str, score: str, options: dict | None = None) -> FittedModel:
        from tuneforge.plans.estimators import boost_config

        cfg = boost_config(options, default_stop, default_leaves)
        binned, binning = data.binned(cfg.n_bins, cfg.binning)
        res = trees.fit_boosted_trees(spark, binned, [cand], score, cfg, binning)
        _raise_failed(res.costs.first())
        nodes = [list(r) for r in res.model.select("round", "level", "node", "feature", "bin", "leaf_value").collect()]
        payload = {"kind": "booster", "nodes": nodes, "base": res.cands[0]["base"], "loss": res.cands[0]["kind"], "binning": asdict(binning)}
        history = [(r["round"], None, r["val_cost"]) for r in res.history.orderBy("round").collect()]
        return FittedModel("booster", task, _plain(cand), data.n_features, payload, history)

    return fit


def _booster_scores(m: FittedModel, rows: DataFrame) -> DataFrame:
    binning = trees.Binning(**m.payload["binning"])
    schema = "trial_id bigint, round int, level int, node bigint, feature int, bin int, leaf_value double"
    table = rows.sparkSession.createDataFrame([(0, *n) for n in m.payload["nodes"]], schema)
    cand = {"trial_id": 0, "base": m.payload["base"], "kind": m.payload["loss"]}
    return trees.predict_boosted(trees.apply_binning(rows, binning, m.n_features), table, [cand])


# ---------------------------------------------------------------- support vector models
def svm_maps(n_features: int, o: dict) -> kernels.FeatureMaps:
    return kernels.FeatureMaps(n_features, o.get("n_components", 64), o.get("seed", 0), o.get("sketch", kernels.SKETCH))


def fit_svm(spark, data, cand: dict, task: str, score: str, options: dict | None = None) -> FittedModel:
    o = dict(options or {})
    kind = "svc" if task == "binary classification" else "svr"
    folds = o.get("platt_folds", 3) if kind == "svc" else 0
    maps = svm_maps(data.n_features, o)
    train = data.folded(folds, maps.seed)
    fits = kernels.fit_steps(train, kernels.new_fits([cand], maps, folds), maps, o.get("n_steps", 20), o.get("lr", 0.5), kind)
    payload = {"kind": "svm", "w": fits[0].w.tolist(), "b": float(fits[0].b), "n_components": maps.n_components, "seed": maps.seed, "sketch": maps.sketch, "platt": None}
    if kind == "svc":
        payload["platt"] = list(kernels.platt_steps(train, fits, maps, o.get("platt_steps", 10))[cand["trial_id"]])
    return FittedModel("svm", task, _plain(cand), data.n_features, payload)


def _svm_scores(m: FittedModel, rows: DataFrame) -> DataFrame:
    maps = svm_maps(m.n_features, m.payload)
    fit = kernels.Fit(0, maps.key(m.params), 1.0, -1, np.array(m.payload["w"]), m.payload["b"])
    scored = kernels.batch_scores(rows, [fit], maps)
    if m.payload["platt"] is None:
        return scored
    a, b = m.payload["platt"]
    return scored.withColumn("decision", F.col("score")).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * F.col("score") + F.lit(b))))


# ---------------------------------------------------------------- perceptron
def fit_network(spark, data, cand: dict, task: str, score: str, options: dict | None = None) -> FittedModel:
    o = dict(options or {})
    weights, history, errors = mlp.fit_mlp(data.rows, [cand], data.n_features, seed=o.get("seed", 0), epochs=o.get("epochs"),
                                           patience=o.get("early_stopping_rounds", 20), n_shards=o.get("n_shards"))
    if errors:
        raise ValueError(errors[cand["trial_id"]])
    payload = {"kind": "mlp", "w": [float(v) for v in weights[cand["trial_id"]]]}
    return FittedModel("mlp", task, _plain(cand), data.n_features, payload, [(e, a, b) for _, e, a, b in history])


def _mlp_scores(m: FittedModel, rows: DataFrame) -> DataFrame:
    scored = None
    for split in [r["split"] for r in rows.select("split").distinct().collect()]:
        part = mlp.predict_scores(rows, {0: np.array(m.payload["w"])}, [dict(m.params, trial_id=0)], m.n_features, split)
        part = part.withColumn("split", F.lit(split))
        scored = part if scored is None else scored.unionByName(part)
    return scored


_SCORERS = {"booster": _booster_scores, "svm": _svm_scores, "mlp": _mlp_scores}


def _plain(cand: dict) -> dict:
    return {k: v for k, v in cand.items() if v is None or isinstance(v, (str, int, float, bool))}


def _raise_failed(row) -> None:
    if row["status"] != "ok":
        raise ValueError(row["error"])
