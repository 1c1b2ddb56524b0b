"""Registered queries: one per operator, each reading the driver tables at ``sf_dir``.

Every computed double is rounded to 6 decimals on output (summation order differs
between engines); the oracle SQL in :mod:`tuneforge.plans.oracle` does the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_uniform
from tuneforge.operators import candidates as cand
from tuneforge.operators import prep
from tuneforge.operators.space import SearchSpace, default_params, default_space
from tuneforge.session import materialize
from tuneforge.sources.features import load_features
from tuneforge.sources.fixtures import LINEITEM_FEATURES, lineitem_planted

R = 6  # output rounding


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, R)


# ---------------------------------------------------------------- preparation
def q_load_features(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem_planted(spark, sf)
    rows = load_features(li, LINEITEM_FEATURES, "reg")
    return rows.select(
        "key", *[F.element_at("features", i + 1).alias(f"f{i}") for i in range(len(LINEITEM_FEATURES))],
        r6("label").alias("label"), "split",
    )


def q_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem_planted(spark, sf).select("key")
    df = prep.train_test_split(li, 0.1, 21, picked="test", rest="train")
    df = prep.train_test_split(df, 0.25, 22, picked="val", rest="train", eligible=F.col("split") == "train")
    return df.select("key", "split")


def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem_planted(spark, sf).select("key", "cls")
    df = prep.stratified_split(li, "cls", 0.1, 31, picked="test", rest="train")
    df = prep.stratified_split(df, "cls", 0.15, 32, picked="val", rest="train", eligible=F.col("split") == "train")
    return df.select("key", "cls", "split")


def q_min_max_scale(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem_planted(spark, sf).withColumn("const", F.lit(1.0))
    cols = LINEITEM_FEATURES + ["const"]
    df = prep.min_max_scale(li, cols, fit_filter=F.col("split") != "test", suffix="_s")
    return df.select("key", "split", *[r6(f"{c}_s").alias(f"s{i}") for i, c in enumerate(cols)])


def q_scale_target(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem_planted(spark, sf)
    df = prep.scale_target(li, "reg", fit_filter=F.col("split") != "test", suffix="_s")
    return df.select("key", "split", r6("reg_s").alias("y_scaled"))


# ---------------------------------------------------------------- candidates
def linear_space_from_data(spark: SparkSession, sf: str) -> SearchSpace:
    """Linear-scorer space whose bounds follow the training target's range."""
    li = lineitem_planted(spark, sf)
    top = li.filter(F.col("split") == "train").agg(F.ceil(F.max("reg")).alias("a")).first()["a"]
    return SearchSpace.from_dict({"a": [0, int(top), 1], "b": [0, 5 * int(top), 0]})


def q_grid_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    space = linear_space_from_data(spark, sf)
    g = cand.decode_candidates(cand.grid_enumerate(spark, space), space)
    return g.select("trial_id", r6("params.a").alias("a"), F.col("params.b").alias("b"))


MLP_COLS = ["optimizer", "learning_rate", "neurons", "hiddenactivation", "activation"]


def q_random_candidates(spark: SparkSession, sf: str) -> DataFrame:
    space = SearchSpace.default("mlp", "binary classification")
    ids = lineitem_planted(spark, sf).select(F.col("key").alias("trial_id"))
    rc = cand.decode_candidates(cand.random_candidates(spark, space, seed=41, ids=ids), space)
    return rc.select(F.col("trial_id").alias("key"), "grid_index", *[F.col(f"params.{c}").alias(c) for c in MLP_COLS])


def hashed_positions(df: DataFrame, space: SearchSpace, seed0: int, key: str = "key") -> Column:
    """Encoded positions drawn uniformly inside the bounds from row keys (one per row)."""
    return F.array(*[
        F.lit(d.lo) + hash_uniform(seed0 + j, F.col(key)) * F.lit(d.hi - d.lo) for j, d in enumerate(space.dims)
    ])


def q_decode_candidates(spark: SparkSession, sf: str) -> DataFrame:
    space = SearchSpace.default("mlp", "binary classification")
    li = lineitem_planted(spark, sf).select("key")
    pos = li.withColumn("pos", hashed_positions(li, space, 50))
    dec = cand.decode_candidates(pos, space)
    extra = ["batch_size", "epochs", "loss", "mode", "shuffle"]
    return dec.select("key", *[F.col(f"params.{c}").alias(c) for c in MLP_COLS + extra])


DEDUPE_SPACE = {
    "optimizer": ["RMSprop", "adam", "sgd", "adamax", "nadam", "adadelta"],
    "learning_rate": [0.1, 0.3, 1],
    "neurons": [1, 8, 0],
    "hiddenactivation": ["relu", "sigmoid", "tanh"],
    "activation": ["relu", "sigmoid", "tanh"],
}


def q_dedupe_candidates(spark: SparkSession, sf: str) -> DataFrame:
    space = SearchSpace.from_dict(DEDUPE_SPACE)
    li = lineitem_planted(spark, sf).select(F.col("key").alias("trial_id"))
    pos = li.withColumn("pos", hashed_positions(li, space, 60, key="trial_id"))
    dec = cand.decode_candidates(pos, space, with_defaults=False)
    dd = cand.dedupe_candidates(dec)
    return dd.select(*[F.col(f"params.{c}").alias(c) for c in MLP_COLS], F.col("trial_id").alias("first_key"), "n_positions")


# ---------------------------------------------------------------- prediction and scoring
from tuneforge.operators import scoring  # noqa: E402
from tuneforge.operators.linear import linear_scores  # noqa: E402

# fixed candidate weights of the scoring fixtures (linear scorer on x1 = quantity/50, x2 = discount)
REG_CANDS = [
    {"trial_id": 0, "a": 1.0, "b": 5.0},
    {"trial_id": 1, "a": 0.5, "b": 0.0},
    {"trial_id": 2, "a": 1.0, "b": 10.0},
    {"trial_id": 3, "a": 0.0, "b": 0.0},
]
CLS_CANDS = [
    {"trial_id": 0, "a": 4.0, "b": 20.0, "c": -3.0},
    {"trial_id": 1, "a": 2.0, "b": 0.0, "c": -1.0},
    {"trial_id": 2, "a": 0.0, "b": 0.0, "c": 0.0},
    {"trial_id": 3, "a": 6.0, "b": 40.0, "c": -5.0},
]


def _xs():
    """Linear-scorer inputs: x1 = quantity / 50, x2 = discount (built lazily: needs a session)."""
    return [F.col("l_quantity") / F.lit(50.0), F.col("l_discount")]


def _reg_scores(spark, sf, label="reg", split="val"):
    li = lineitem_planted(spark, sf).withColumn("label", F.col(label))
    if split:
        li = li.filter(F.col("split") == split)
    return linear_scores(li, REG_CANDS, _xs(), ["a", "b"])


def _cls_proba(spark, sf, split="val", ties=False):
    li = lineitem_planted(spark, sf).withColumn("label", F.col("cls"))
    if split:
        li = li.filter(F.col("split") == split)
    s = linear_scores(li, CLS_CANDS, _xs(), ["a", "b"], intercept="c")
    p = scoring.sigmoid(F.col("score"))
    return s.withColumn("score", F.round(p, 1) if ties else p)


def q_predict(spark, sf):
    return _reg_scores(spark, sf).select("trial_id", "key", r6("score").alias("pred"))


def q_predict_proba(spark, sf):
    return _cls_proba(spark, sf).select("trial_id", "key", r6("score").alias("proba"))


def q_score_rmse(spark, sf):
    c = scoring.rmse_cost(_reg_scores(spark, sf), ["trial_id"])
    return c.select("trial_id", r6("cost").alias("cost"))


def q_score_accuracy(spark, sf):
    p = _cls_proba(spark, sf).withColumn("pred_label", scoring.threshold_label(F.col("score")))
    return scoring.accuracy_cost(p, ["trial_id"]).select("trial_id", r6("cost").alias("cost"))


def q_score_accuracy_rounded(spark, sf):
    p = _reg_scores(spark, sf, label="cls").withColumn("pred_label", scoring.rounded_label(F.col("score")))
    return scoring.accuracy_cost(p, ["trial_id"]).select("trial_id", r6("cost").alias("cost"))


def q_roc_curve(spark, sf):
    roc = scoring.roc_curve(_cls_proba(spark, sf, ties=True), ["trial_id"])
    return roc.select("trial_id", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def q_score_auc(spark, sf):
    a = scoring.auc_value(_cls_proba(spark, sf, ties=True), ["trial_id"], alias="auc")
    return a.select("trial_id", r6("auc").alias("auc"), r6(F.lit(1.0) - F.col("auc")).alias("cost"))


def q_score_auc_distinct(spark, sf):
    """AUC on scores at 9 decimals: about as many distinct ones as rows."""
    a = scoring.auc_value(_cls_proba(spark, sf).withColumn("score", F.round("score", 9)), ["trial_id"], alias="auc")
    return a.select("trial_id", r6("auc").alias("auc"))


def q_score_holdout(spark, sf):
    """Best candidate by validation AUC (first strict minimum of 1-AUC), scored on the test split."""
    both = _cls_proba(spark, sf, split=None)
    val = scoring.auc_cost(both.filter(F.col("split") == "val"), ["trial_id"])
    best = val.agg(F.min(F.struct(F.round("cost", 9).alias("c"), F.col("trial_id").alias("t"))).alias("b"))
    best = best.select(F.col("b.t").alias("trial_id"), F.col("b.c").alias("val_cost"))
    test = both.filter(F.col("split") == "test").join(F.broadcast(best.select("trial_id")), "trial_id", "left_semi")
    t = scoring.auc_value(test, ["trial_id"], alias="test_auc")
    return t.join(best, "trial_id").select("trial_id", r6("val_cost").alias("val_cost"), r6("test_auc").alias("test_auc"))


# ---------------------------------------------------------------- swarm and search
from tuneforge.operators import selection  # noqa: E402
from tuneforge.operators import swarm as sw  # noqa: E402
from tuneforge.plans import search  # noqa: E402

SWARM_SPACE = {"a": [0, 3, 2], "b": [0, 10, 1]}
COARSE_SPACE = {"a": [0, 3, 0], "b": [0, 10, 0]}


def _val_rows(spark, sf, label="reg"):
    return lineitem_planted(spark, sf).withColumn("label", F.col(label))


def _lin_fit(spark, sf, cost_fn=None):
    return search.linear_fitness(_val_rows(spark, sf), _xs(), ["a", "b"], split="val", cost_fn=cost_fn)


def _xcols(prefix, col, n=2):
    return [r6(F.element_at(col, j + 1)).alias(f"{prefix}{j}") for j in range(n)]


def q_swarm_init(spark, sf):
    space = SearchSpace.from_dict(SWARM_SPACE)
    s = sw.swarm_init(spark, space, 8, seed=5)
    s = sw.swarm_evaluate(s, space, _lin_fit(spark, sf))
    return s.select("pid", *_xcols("x", "x"), *_xcols("v", "v"), r6("cost").alias("cost"))


def q_swarm_evaluate(spark, sf):
    space = SearchSpace.from_dict(COARSE_SPACE)
    s = sw.swarm_init(spark, space, 20, seed=6)
    s = sw.swarm_evaluate(s, space, _lin_fit(spark, sf))
    dec = cand.decode_columns(space, F.col("x"))
    return s.select("pid", *dec, r6("cost").alias("cost"))


def _global_iterations(spark, sf, iters, seed=5, n=8, local_k=None):
    space = SearchSpace.from_dict(SWARM_SPACE)
    fit = _lin_fit(spark, sf)
    s = sw.swarm_init(spark, space, n, seed=seed)
    snaps = []
    for it in range(iters):
        s = sw.swarm_evaluate(s, space, fit)
        s = sw.personal_best(s)
        s = sw.global_best(s)
        if local_k:
            s = sw.local_best(s, local_k, 2.0)
        s = search.cut_lineage(s)
        snaps.append(s.withColumn("iteration", F.lit(it)))
        if it < iters - 1:
            s = sw.swarm_move(s, space, it, seed)
    return space, s, snaps


def q_swarm_move(spark, sf):
    space, s, _ = _global_iterations(spark, sf, 1)
    m = sw.swarm_move(s, space, 0, 5)
    return m.select("pid", *_xcols("x", "x"), *_xcols("v", "v"))


def q_personal_best(spark, sf):
    _, s, _ = _global_iterations(spark, sf, 3)
    return s.select("pid", *_xcols("pb", "pbest_x"), r6("pbest_cost").alias("pbest_cost"))


def q_global_best(spark, sf):
    _, _, snaps = _global_iterations(spark, sf, 3)
    rows = [x.filter(F.col("pid") == 0).select("iteration", *_xcols("best_x", "gbest_x"), r6("gbest_cost").alias("best_cost")) for x in snaps]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def q_local_best(spark, sf):
    _, s, _ = _global_iterations(spark, sf, 3, local_k=3)
    return s.select("pid", *_xcols("nb", "nbest_x"), r6("nbest_cost").alias("nbest_cost"))


def q_search_trace(spark, sf):
    _, _, snaps = _global_iterations(spark, sf, 4)
    out = None
    for x in snaps:
        t = x.select("iteration", "pid", *_xcols("x", "x"), r6("cost").alias("cost"), r6("gbest_cost").alias("best_cost"))
        out = t if out is None else out.unionByName(t)
    return out


def _pso_summary(res: search.SearchResult, space: SearchSpace) -> DataFrame:
    last = res.trials.filter(F.col("iteration") == res.extra["iterations"] - 1).filter(F.col("pid") == 0)
    dec = cand.decode_columns(space, F.col("best_x"))
    return last.select(
        r6("best_cost").alias("best_cost"), *dec,
        F.lit(res.attempts).cast("bigint").alias("attempts"),
        F.lit(res.total_combinations).cast("bigint").alias("total_combinations"),
    )


def q_search_pso(spark, sf):
    space = SearchSpace.from_dict(SWARM_SPACE)
    res = search.search_pso(spark, space, _lin_fit(spark, sf), n_particles=5, iterations=10, seed=0)
    return _pso_summary(res, space)


def _mae_cost(scores: DataFrame) -> DataFrame:
    """A user objective: mean absolute error, any aggregate over (candidate, row) works."""
    return scores.groupBy("trial_id").agg(F.avg(F.abs(F.col("label") - F.col("score"))).alias("cost"))


def q_custom_objective(spark, sf):
    space = SearchSpace.from_dict(SWARM_SPACE)
    res = search.search_pso(spark, space, _lin_fit(spark, sf, cost_fn=_mae_cost), n_particles=6, iterations=3, seed=3)
    return res.history.select("iteration", r6("best_cost").alias("best_cost"))


class _NoisyFitness:
    """Stochastic fitness: RMSE on a fresh hash subsample of validation rows per call."""

    def __init__(self, rows: DataFrame, seed: int = 77, fraction: float = 0.5):
        self.rows, self.seed, self.fraction, self.calls = rows, seed, fraction, 0

    def __call__(self, cands: DataFrame) -> DataFrame:
        it = self.calls
        self.calls += 1
        sub = self.rows.filter((F.col("split") == "val") & (hash_uniform(self.seed, F.lit(it), F.col("key")) < self.fraction))
        batch = search.collect_batch(cands, ["a", "b"])
        return search.rmse_cost(search.linear_scores(sub, batch, _xs(), ["a", "b"]), ["trial_id"])


def q_elite_retention(spark, sf):
    space = SearchSpace.from_dict(COARSE_SPACE)
    res = search.search_pso(spark, space, _NoisyFitness(_val_rows(spark, sf)), n_particles=6, iterations=4, seed=8, elite=True)
    return res.trials.select("iteration", "pid", r6("raw_cost").alias("raw_cost"), r6("cost").alias("cost"))


def _grid_trials(spark, sf):
    space = linear_space_from_data(spark, sf)
    return space, search.search_grid(spark, space, _lin_fit(spark, sf))


def q_search_grid(spark, sf):
    _, res = _grid_trials(spark, sf)
    return res.trials.select("trial_id", r6("a").alias("a"), "b", r6("cost").alias("cost"))


def q_search_random(spark, sf):
    space = linear_space_from_data(spark, sf)
    res = search.search_random(spark, space, _lin_fit(spark, sf), n_attempts=20, seed=9)
    return res.trials.select("trial_id", "grid_index", r6("a").alias("a"), "b", r6("cost").alias("cost"))


def q_select_best(spark, sf):
    _, res = _grid_trials(spark, sf)
    best = selection.select_best(res.trials.select("trial_id", "a", "b", "cost"))
    return best.select("trial_id", r6("a").alias("a"), "b", r6("cost").alias("cost"))


def q_leaderboard(spark, sf):
    _, res = _grid_trials(spark, sf)
    lb = selection.leaderboard(res.trials.select("trial_id", "a", "b", "cost"), 10)
    return lb.select("rank", "trial_id", r6("a").alias("a"), "b", r6("cost").alias("cost"))


def q_rebuild_best(spark, sf):
    """The winning linear model is its parameters: no refit; score it on the test split."""
    _, res = _grid_trials(spark, sf)
    best = selection.select_best(res.trials.select("trial_id", "a", "b", "cost"))
    model = search.collect_batch(best.select("trial_id", F.struct("a", "b").alias("params")), ["a", "b"])
    test = search.rmse_cost(search.linear_scores(_val_rows(spark, sf).filter(F.col("split") == "test"), model, _xs(), ["a", "b"]), ["trial_id"], alias="test_cost")
    return best.join(test, "trial_id").select("trial_id", r6("a").alias("a"), "b", r6("cost").alias("val_cost"), r6("test_cost").alias("test_cost"))


FAILED_SPACE = {"objective": ["squared", "gamma"], "a": [0.5, 1.5, 1], "b": [0, 10, 0]}


def q_failed_trials(spark, sf):
    """Gamma candidates need a strictly positive target; ``reg - 0.75`` is not, so they fail."""
    space = SearchSpace.from_dict(FAILED_SPACE)
    rows = _val_rows(spark, sf).withColumn("label", F.col("reg") - F.lit(0.75)).filter(F.col("split") == "val")
    grid = cand.decode_candidates(cand.grid_enumerate(spark, space), space, with_defaults=False)
    batch = search.collect_batch(grid, ["a", "b"])
    scores = linear_scores(rows, batch, _xs(), ["a", "b"])
    # candidate table: bounded by the batch size checked in collect_batch
    scores = scores.join(F.broadcast(grid.select("trial_id", F.col("params.objective").alias("objective"))), "trial_id")
    pred = F.when(F.col("objective") == "gamma", F.exp(F.col("score"))).otherwise(F.col("score"))
    costs = scores.withColumn("pred", pred).groupBy("trial_id", "objective").agg(
        F.sqrt(F.avg(F.pow(F.col("label") - F.col("pred"), 2))).alias("cost"), F.min("label").alias("min_label"))
    valid = (F.col("objective") != "gamma") | (F.col("min_label") > 0)
    marked = selection.mark_failed(costs, valid, F.lit("gamma objective needs a strictly positive target"))
    out = grid.select("trial_id", F.col("params.a").alias("a"), F.col("params.b").alias("b")).join(marked, "trial_id")
    return out.select("trial_id", "objective", r6("a").alias("a"), "b", "status", r6("cost").alias("cost"))


# ---------------------------------------------------------------- boosted trees
from tuneforge.operators import trees  # noqa: E402

TREE_BINS = 16


def tree_rows(spark, sf, label="reg", method="uniform", n_bins=TREE_BINS):
    li = lineitem_planted(spark, sf)
    rows = materialize(load_features(li, LINEITEM_FEATURES, label))  # made once for bins, fit and predictions
    binning = trees.fit_binning(rows, len(LINEITEM_FEATURES), n_bins, method, fit_filter=F.col("split") == "train")
    return trees.apply_binning(rows, binning, len(LINEITEM_FEATURES)), binning


# fixed tree-query candidate sets: (objective, learning rates, depth, rounds, subsample, label, score)
TREE_CASES = {
    "boosted_stump_round": ("reg:linear", [0.1, 0.3, 0.5, 1.0], 1, 1, 1.0, "reg", "rmse"),
    "objective_squared": ("reg:linear", [0.3, 1.0], 2, 1, 1.0, "reg", "rmse"),
    "objective_logistic": ("binary:logistic", [0.3, 1.0], 2, 1, 1.0, "cls", "acc"),
    "objective_gamma": ("reg:gamma", [0.3, 1.0], 2, 1, 1.0, "reg_positive", "rmse"),
    "objective_tweedie": ("reg:tweedie", [0.3, 1.0], 2, 1, 1.0, "reg_positive", "rmse"),
    "row_subsample": ("reg:linear", [0.5, 0.5], 1, 2, [0.7, 0.9], "reg", "rmse"),
    "boosted_depth2": ("reg:linear", [0.3, 1.0], 2, 2, 1.0, "reg", "rmse"),
    "shrinkage_step": ("reg:linear", [0.1, 0.5], 1, 3, 1.0, "reg", "rmse"),
    "early_stopping": ("reg:linear", [1.0, 0.3], 2, 5, 1.0, "reg", "rmse"),
}
ES_PATIENCE = 2


def tree_case_cands(name):
    obj, lrs, depth, rounds, sub, _, _ = TREE_CASES[name]
    subs = sub if isinstance(sub, list) else [sub] * len(lrs)
    return [{"trial_id": i, "objective": obj, "learning_rate": lr, "max_depth": depth, "n_estimators": rounds, "subsample": s}
            for i, (lr, s) in enumerate(zip(lrs, subs))]


def _tree_case(spark, sf, name, data=None, **cfg):
    _, _, _, _, _, label, score = TREE_CASES[name]
    binned, binning = data or tree_rows(spark, sf, label)
    return trees.fit_boosted_trees(spark, binned, tree_case_cands(name), score, trees.BoostConfig(seed=13, record_history=True, **cfg), binning)


def _model_with_cost(res):
    m = res.model.join(res.costs.select("trial_id", "cost"), "trial_id")
    return m.select("trial_id", "round", "level", "node", "feature", "bin", r6("leaf_value").alias("leaf_value"), r6("cost").alias("cost"))


def q_quantile_bin(spark, sf):
    li = lineitem_planted(spark, sf)
    rows = materialize(load_features(li, LINEITEM_FEATURES, "reg"))
    b = trees.fit_binning(rows, len(LINEITEM_FEATURES), 32, "quantile", fit_filter=F.col("split") == "train")
    binned = trees.apply_binning(rows, b, len(LINEITEM_FEATURES))
    # bin occupancy per feature: the binned table aggregated
    return binned.select(F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n_rows"))


def q_boosted_stump_round(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "boosted_stump_round"))


def q_objective_squared(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "objective_squared"))


def q_objective_logistic(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "objective_logistic"))


def q_objective_gamma(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "objective_gamma"))


def q_objective_tweedie(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "objective_tweedie"))


def q_row_subsample(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "row_subsample"))


def q_boosted_depth2(spark, sf):
    return _model_with_cost(_tree_case(spark, sf, "boosted_depth2"))


def q_shrinkage_step(spark, sf):
    res = _tree_case(spark, sf, "shrinkage_step")
    return res.history.select("trial_id", "round", r6("val_cost").alias("val_cost"))


def q_early_stopping(spark, sf):
    res = _tree_case(spark, sf, "early_stopping", early_stopping_rounds=ES_PATIENCE)
    return res.costs.select("trial_id", r6("cost").alias("cost"), "best_round")


LEAF_WISE = [{"trial_id": 0, "objective": "regression", "learning_rate": 0.5, "max_depth": 5, "n_estimators": 1, "subsample": 1.0},
             {"trial_id": 1, "objective": "tweedie", "learning_rate": 0.3, "max_depth": 2, "n_estimators": 1, "subsample": 0.8}]


def q_gbdt_leaf_wise(spark, sf):
    """One round of best-first growth to 4 leaves: the tree of each candidate."""
    binned, binning = tree_rows(spark, sf, "reg_positive")
    res = trees.fit_boosted_trees(spark, binned, LEAF_WISE, "rmse", trees.BoostConfig(seed=13, max_leaves=4), binning)
    return res.model.select("trial_id", "level", "node", "feature", "bin", r6("leaf_value").alias("leaf_value"))


# ---------------------------------------------------------------- flagship: booster grid search
FLAGSHIP_SPACE = {
    "objective": ["reg:linear", "reg:tweedie"],
    "max_depth": [1, 2, 0],
    "learning_rate": [0.1, 0.3, 1],
    "n_estimators": [2, 2, 0],
}
FLAGSHIP_OPTIONS = {"binning": "uniform", "n_bins": TREE_BINS, "seed": 13}


def flagship_candidates(space_dict=None, estimator="xgboost", task="regression"):
    """The grid of a small space as decoded dicts (trial order = grid order), defaults merged."""
    space = SearchSpace.from_dict(space_dict or FLAGSHIP_SPACE, default_params(estimator, task))
    out, cards = [], space.cardinalities
    for idx in range(space.total):
        rem, d = idx, {}
        for j in reversed(range(space.n_dims)):
            digit = rem % cards[j]
            rem //= cards[j]
            dim = space.dims[j]
            d[dim.name] = dim.categories[digit] if dim.is_categorical else (
                int(round(dim.lo + digit * dim.step)) if dim.decimals == 0 else round(dim.lo + digit * dim.step, dim.decimals))
        out.append(dict(space.defaults, **d, trial_id=idx))
    return out


def q_fit_boosted_trees(spark, sf):
    from tuneforge.plans.facade import HyperSearch

    li = lineitem_planted(spark, sf)
    hs = HyperSearch(spark, "xgboost", FLAGSHIP_SPACE, "regression", "rmse", options=FLAGSHIP_OPTIONS)
    data = hs.prepare(li, LINEITEM_FEATURES, "reg_positive")
    res = hs.fit_grid(data)
    return res.trials.select("trial_id", "objective", "max_depth", r6("learning_rate").alias("learning_rate"),
                             "n_estimators", r6("cost").alias("cost"))


# ---------------------------------------------------------------- support vector models
from tuneforge.operators import svm  # noqa: E402

SVM_CANDS = [{"trial_id": 0, "C": 0.1}, {"trial_id": 1, "C": 1.0}, {"trial_id": 2, "C": 10.0}]
SVM_STEPS, SVM_LR = 3, 0.5
SVM_FOLDS, SVM_FOLD_SEED = 3, 17
RFF_GAMMA, RFF_M, RFF_SEED = 0.5, 8, 21
POLY_DEGREE, POLY_GAMMA = 2, 0.5


def svm_rows(spark, sf, label="cls"):
    """Planted lineitem, features min-max scaled on the training rows."""
    li = lineitem_planted(spark, sf)
    sc = prep.min_max_scale(li, LINEITEM_FEATURES, fit_filter=F.col("split") == "train", suffix="_s")
    return load_features(sc, [f"{c}_s" for c in LINEITEM_FEATURES], label)


def _weights_table(spark, weights):
    rows = [(tid, *[float(v) for v in w], float(b)) for tid, (w, b) in weights.items()]
    return spark.createDataFrame(rows, "trial_id bigint, w0 double, w1 double, w2 double, w3 double, b double")


def q_svm_linear_steps(spark, sf):
    rows = svm_rows(spark, sf)
    wts = svm.hinge_steps(rows, SVM_CANDS, 4, SVM_STEPS, SVM_LR, "svc")
    sc = svm.decision_scores(rows.filter(F.col("split") == "val"), wts, 4)
    acc = scoring.accuracy_cost(sc.withColumn("pred_label", F.when(F.col("score") > 0, 1.0).otherwise(0.0)), ["trial_id"])
    wt = _weights_table(spark, wts)
    return wt.join(acc, "trial_id").select("trial_id", *[r6(f"w{j}").alias(f"w{j}") for j in range(4)], r6("b").alias("b"), r6("cost").alias("cost"))


def q_svr_steps(spark, sf):
    rows = svm_rows(spark, sf, "reg")
    wts = svm.hinge_steps(rows, SVM_CANDS, 4, SVM_STEPS, SVM_LR, "svr")
    sc = svm.decision_scores(rows.filter(F.col("split") == "val"), wts, 4)
    cost = scoring.rmse_cost(sc, ["trial_id"])
    wt = _weights_table(spark, wts)
    return wt.join(cost, "trial_id").select("trial_id", *[r6(f"w{j}").alias(f"w{j}") for j in range(4)], r6("b").alias("b"), r6("cost").alias("cost"))


def q_rff_features(spark, sf):
    rows = svm_rows(spark, sf).filter(F.col("split") == "train")
    omega, phase = svm.rff_params(4, RFF_M, RFF_GAMMA, RFF_SEED)
    z = svm.rff_transform(rows, 4, omega, phase)
    return z.select(F.posexplode("features").alias("m", "z")).groupBy("m").agg(r6(F.sum("z")).alias("z_sum"))


def q_poly_features(spark, sf):
    rows = svm_rows(spark, sf).filter(F.col("split") == "train")
    z = svm.poly_transform(rows, 4, POLY_DEGREE, POLY_GAMMA)
    return z.select(F.posexplode("features").alias("m", "z")).groupBy("m").agg(r6(F.sum("z")).alias("z_sum"))


def q_svm_probability(spark, sf):
    rows = svm_rows(spark, sf)
    sc = svm.out_of_fold_scores(rows, SVM_CANDS, 4, SVM_STEPS, SVM_LR, "svc", SVM_FOLDS, SVM_FOLD_SEED)
    ab = svm.platt_scaling(sc.select("trial_id", "label", "score"), n_steps=2)
    out = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in ab.items()], "trial_id bigint, A double, B double")
    return out.select("trial_id", r6("A").alias("A"), r6("B").alias("B"))


def _svm_search(spark, sf, space, seed):
    """Random search with the estimator's default options over planted lineitem."""
    from tuneforge.plans.facade import HyperSearch

    li = lineitem_planted(spark, sf)
    sc = prep.min_max_scale(li, LINEITEM_FEATURES, fit_filter=F.col("split") == "train", suffix="_s")
    hs = HyperSearch(spark, "svm", space, "binary classification", "acc")
    data = hs.prepare(sc, [f"{c}_s" for c in LINEITEM_FEATURES], "cls")
    res = hs.fit_random(data, seed=seed)
    return res.trials.select("trial_id", "kernel", r6("gamma").alias("gamma"), r6("C").alias("C"), r6("cost").alias("cost"),
                             *(["degree"] if space is None or "degree" in space else []))


def q_fit_svm_rbf(spark, sf):
    return _svm_search(spark, sf, {"kernel": ["rbf"], "gamma": [0.1, 10, 1], "C": [0.1, 10, 1]}, 5)


def q_fit_svm_poly(spark, sf):
    return _svm_search(spark, sf, {"kernel": ["poly"], "gamma": [0.1, 2, 1], "C": [0.1, 10, 1], "degree": [0, 6, 0]}, 6)


def q_search_random_svm(spark, sf):
    """The estimator's default space: three kernels, 100 values of gamma and of C, degrees 0 to 6."""
    return _svm_search(spark, sf, None, 8)


# ---------------------------------------------------------------- multi-layer perceptron
MLP_EPOCHS = 50     # the default of the search space's parameters


def _mlp_search(spark, sf):
    from tuneforge.plans.facade import HyperSearch
    from tuneforge.sources.fixtures import events_planted

    ev = events_planted(spark, sf)
    sc = prep.min_max_scale(ev, ["value", "hour"], fit_filter=F.col("split") == "train", suffix="_s")
    hs = HyperSearch(spark, "mlp", None, "binary classification", "auc", options={"epochs": MLP_EPOCHS, "seed": 4})
    data = hs.prepare(sc, ["value_s", "hour_s"], "label")
    return hs, data, hs.fit_random(data, n_attempts=4, seed=12)


def q_fit_mlp(spark, sf):
    _, _, res = _mlp_search(spark, sf)
    return res.trials.select("trial_id", "optimizer", r6("learning_rate").alias("learning_rate"), "neurons",
                             "hiddenactivation", "activation", r6("cost").alias("cost"))


def q_training_history(spark, sf):
    """The history of the winner's model, epoch by epoch."""
    hs, data, res = _mlp_search(spark, sf)
    hist = hs.best_model(data, res).history_table(spark)
    return hist.select("epoch", r6("train_loss").alias("train_loss"), r6("val_loss").alias("val_loss"))


# ---------------------------------------------------------------- sink
def q_save_search(spark, sf):
    from tuneforge.sources.sinks import save_search

    _, res = _grid_trials(spark, sf)
    meta = {"estimator": "linear", "task": "regression", "selection_type": "Grid",
            "attempts": res.attempts, "total_combinations": res.total_combinations, "duration": res.duration}
    _, summary = save_search(spark, res.trials.select("trial_id", "a", "b", "cost"), ["a", "b"], meta)
    # duration is wall-clock: stored, not compared
    return summary.select("estimator", "task", "selection_type", "attempts", "total_combinations",
                          r6("a").alias("a"), "b", "best_cost")


GBDT_SPACE = {"learning_rate": [0.1, 0.3, 1], "max_depth": [1, 2, 0], "n_estimators": [3, 3, 0], "subsample": [0.8, 1, 1]}


def gbdt_candidates():
    return flagship_candidates(GBDT_SPACE, "gbdt", "binary classification")


def q_fit_gbdt(spark, sf):
    """The gbdt estimator: same batched booster, logistic objective, early stopping (patience 20) on."""
    from tuneforge.plans.facade import HyperSearch

    li = lineitem_planted(spark, sf)
    hs = HyperSearch(spark, "gbdt", GBDT_SPACE, "binary classification", "auc", options=FLAGSHIP_OPTIONS)
    data = hs.prepare(li, LINEITEM_FEATURES, "cls")
    res = hs.fit_grid(data)
    return res.trials.select("trial_id", r6("learning_rate").alias("learning_rate"), "max_depth", "n_estimators",
                             r6("subsample").alias("subsample"), r6("cost").alias("cost"))


PSO_TREE_SPACE = {"learning_rate": [0.1, 0.3, 2], "max_depth": [1, 3, 0], "n_estimators": [2, 4, 0], "subsample": [0.7, 1, 2]}


def q_search_pso_boosted(spark, sf):
    """The reference's headline workflow: particle swarm over the booster's parameters; each
    iteration fits the whole swarm as one batch (rows-only: iterative fit)."""
    from tuneforge.plans.facade import HyperSearch

    li = lineitem_planted(spark, sf)
    hs = HyperSearch(spark, "xgboost", PSO_TREE_SPACE, "regression", "rmse", options=dict(FLAGSHIP_OPTIONS, binning="quantile"))
    data = hs.prepare(li, LINEITEM_FEATURES, "reg_positive")
    res = hs.fit_pso(data, n_particles=4, n_iterations=3, seed=1)
    return res.trials.select("iteration", "pid", F.col("params.learning_rate").alias("learning_rate"),
                             F.col("params.max_depth").alias("max_depth"), F.col("params.n_estimators").alias("n_estimators"),
                             F.col("params.subsample").alias("subsample"), r6("cost").alias("cost"), r6("best_cost").alias("best_cost"))


PSO_MLP_EPOCHS = 2


def q_search_pso_mlp(spark, sf):
    """The published configuration's shape: global-best swarm, 5 particles x 10 iterations over the
    default mlp space, AUC on a stratified-free planted binary task (events); every iteration
    trains the swarm as one batch, ``PSO_MLP_EPOCHS`` epochs per fit (rows-only)."""
    from tuneforge.plans.facade import HyperSearch
    from tuneforge.sources.fixtures import events_planted

    ev = events_planted(spark, sf)
    sc = prep.min_max_scale(ev, ["value", "hour"], fit_filter=F.col("split") == "train", suffix="_s")
    hs = HyperSearch(spark, "mlp", None, "binary classification", "auc", options={"epochs": PSO_MLP_EPOCHS, "seed": 4})
    data = hs.prepare(sc, ["value_s", "hour_s"], "label")
    res = hs.fit_pso(data, n_particles=5, n_iterations=10, seed=2)
    return res.trials.select("iteration", "pid", F.col("params.optimizer").alias("optimizer"),
                             F.col("params.learning_rate").alias("learning_rate"), F.col("params.neurons").alias("neurons"),
                             F.col("params.hiddenactivation").alias("hiddenactivation"), F.col("params.activation").alias("activation"),
                             r6("cost").alias("cost"), r6("best_cost").alias("best_cost"))


def q_predict_boosted(spark, sf):
    """Fitted booster models applied to the test split from the model table alone."""
    binned, binning = tree_rows(spark, sf, "reg")
    res = _tree_case(spark, sf, "boosted_depth2", (binned, binning))
    pred = trees.predict_boosted(binned.filter(F.col("split") == "test"), res.model, res.cands)
    return pred.select("trial_id", "key", r6("score").alias("pred"))


# ---------------------------------------------------------------- the winner's model
def q_rebuild_boosted(spark, sf):
    """Flagship grid, then the winner's model from its trial row: cost on validation and test rows."""
    from tuneforge.plans.facade import HyperSearch

    li = lineitem_planted(spark, sf)
    hs = HyperSearch(spark, "xgboost", FLAGSHIP_SPACE, "regression", "rmse", options=FLAGSHIP_OPTIONS)
    data = hs.prepare(li, LINEITEM_FEATURES, "reg_positive")
    model = hs.best_model(data, hs.fit_grid(data))
    scored = model.scores(data.rows.filter(F.col("split").isin("val", "test")))
    cost = scored.groupBy("split").agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("score"), 2))).alias("cost"))
    return cost.select(F.lit(model.params["trial_id"]).cast("bigint").alias("trial_id"), "split", r6("cost").alias("cost"))


WALK_SPACE = {"objective": ["reg:linear"], "max_depth": [1, 3, 0], "learning_rate": [0.1, 0.5, 1], "n_estimators": [2, 3, 0]}


def q_regression_walkthrough(spark, sf):
    """The regression use from end to end: features and target min-max scaled on the training rows, grid
    search by validation RMSE, the winner's model, and its RMSE on the test rows in the target's own units."""
    from tuneforge.plans.facade import HyperSearch

    li, train = lineitem_planted(spark, sf), F.col("split") == "train"
    target = prep.min_max_fit(li, ["reg"], train)
    scaled = prep.min_max_apply(prep.min_max_scale(li, LINEITEM_FEATURES, fit_filter=train, suffix="_s"), target, suffix="_s")
    hs = HyperSearch(spark, "xgboost", WALK_SPACE, "regression", "rmse", options=FLAGSHIP_OPTIONS)
    data = hs.prepare(scaled, [f"{c}_s" for c in LINEITEM_FEATURES], "reg_s")
    res = hs.fit_grid(data)
    model = hs.best_model(data, res)
    low, high = target["reg"]
    held = model.scores(data.rows.filter(F.col("split") == "test"))
    error = F.pow((F.col("label") - F.col("score")) * F.lit(high - low), 2)
    won = hs.best(res).first()
    return held.agg(F.count(F.lit(1)).alias("n_test"), r6(F.sqrt(F.avg(error))).alias("test_rmse")).select(
        F.lit(won["trial_id"]).cast("bigint").alias("trial_id"), F.lit(won["max_depth"]).cast("bigint").alias("max_depth"), r6(F.lit(won["learning_rate"])).alias("learning_rate"),
        F.lit(won["n_estimators"]).cast("bigint").alias("n_estimators"), r6(F.lit(won["cost"])).alias("cost"), "n_test", "test_rmse")


def q_rebuild_svm(spark, sf):
    """Random search of the linear support vector model, then the winner's classes on the test rows."""
    from tuneforge.plans.facade import HyperSearch

    li = lineitem_planted(spark, sf)
    sc = prep.min_max_scale(li, LINEITEM_FEATURES, fit_filter=F.col("split") == "train", suffix="_s")
    hs = HyperSearch(spark, "svm", {"kernel": ["linear"], "gamma": [0.1, 10, 1], "C": [0.1, 10, 1]}, "binary classification", "acc")
    data = hs.prepare(sc, [f"{c}_s" for c in LINEITEM_FEATURES], "cls")
    model = hs.best_model(data, hs.fit_random(data, n_attempts=4, seed=5))
    pred = model.predict(data.rows.filter(F.col("split") == "test")).join(data.rows.select("key", "label"), "key")
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
