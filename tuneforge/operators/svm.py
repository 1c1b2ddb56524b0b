"""Support vector models as full-batch distributed optimisation (the ``svm`` estimator).

Weights of a candidate batch live on the driver (K x (d+1) numbers, bounded); every
optimisation step is ONE job over the rows that returns the gradients of all candidates as one
packed vector (``kernels.fit_steps``): driver-side weights, distributed gradient aggregation.

* linear SVC: hinge loss, ``lambda = 1 / (C n)`` (same minimiser as ``C sum hinge + |w|^2 / 2``)
* SVR: epsilon-insensitive loss (epsilon = 0.1)
* rbf kernel: random Fourier features (Rahimi & Recht 2007), then the linear model
* poly kernel: explicit degree-d monomial map of ``(gamma x.x')^d`` (coef0 = 0), beyond a number of
  monomials TensorSketch, then linear
* probabilities: Platt scaling fitted by Newton steps (one aggregate per step) on out-of-fold
  scores of the training rows, never on the rows that are scored with it

The exact kernel SMO solver is single-machine and is not rebuilt; the kernel models are
approximations with a declared dimension and seed.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_uniform
from tuneforge.operators.kernels import SVR_EPSILON, FeatureMaps, Fit, batch_scores, fit_steps, new_fits
from tuneforge.session import cut_lineage

def _linear_table(rows: DataFrame, feature_col: str, fold: Column | None = None) -> DataFrame:
    return rows.select(F.col(feature_col).alias("features"), "label", (F.lit(0) if fold is None else fold).cast("int").alias("fold"))


def hinge_steps(rows: DataFrame, cands: list[dict], n_features: int, n_steps: int, lr: float = 0.5,
                kind: str = "svc", eps: float = SVR_EPSILON, feature_col: str = "features") -> dict:
    """Full-batch subgradient descent of linear models for every candidate (``C`` from the dict): one
    job a step, the gradients of all candidates in one packed vector.

    Returns ``{trial_id: (w list, b)}``. Step t uses ``eta = lr / (1 + t)``.
    """
    maps = FeatureMaps(n_features)
    fits = new_fits([dict(c, kernel="linear") for c in cands], maps)
    train = _linear_table(rows.filter(F.col("split") == "train"), feature_col)
    return {f.trial_id: (f.w.tolist(), float(f.b)) for f in fit_steps(train, fits, maps, n_steps, lr, kind, eps)}


def decision_scores(rows: DataFrame, weights: dict, n_features: int, feature_col: str = "features",
                    keep=("key", "label", "split")) -> DataFrame:
    """``(trial_id, *keep, score)``: decision value of every candidate on every row."""
    fits = [Fit(tid, ("linear",), 1.0, -1, np.array(w, float), float(b)) for tid, (w, b) in weights.items()]
    return batch_scores(rows.select(*keep, F.col(feature_col).alias("features")), fits, FeatureMaps(n_features), tuple(keep))


# ---------------------------------------------------------------- kernel feature maps
def rff_params(n_features: int, n_components: int, gamma: float, seed: int) -> tuple[list[list[float]], list[float]]:
    """omega ~ N(0, 2 gamma I) by Box-Muller from seeded md5 uniforms; phase ~ U[0, 2 pi)."""
    import hashlib

    def u(*parts):
        h = hashlib.md5(":".join(str(p) for p in (seed,) + parts).encode()).hexdigest()[:8]
        return int(h, 16) / 4294967296.0

    omega = [[math.sqrt(2.0 * gamma) * math.sqrt(-2.0 * math.log(1.0 - u("w1", m, j))) * math.cos(2.0 * math.pi * u("w2", m, j))
              for j in range(n_features)] for m in range(n_components)]
    phase = [2.0 * math.pi * u("b", m) for m in range(n_components)]
    return omega, phase


def rff_transform(rows: DataFrame, n_features: int, omega, phase, feature_col: str = "features", out_col: str = "features") -> DataFrame:
    """``z_m(x) = sqrt(2/M) cos(omega_m . x + phase_m)``, all JVM-side expressions."""
    M = len(omega)
    xs = [F.element_at(feature_col, j + 1) for j in range(n_features)]
    zs = []
    for m in range(M):
        acc = None
        for j in range(n_features):
            t = F.lit(float(omega[m][j])) * xs[j]
            acc = t if acc is None else acc + t
        zs.append(F.lit(math.sqrt(2.0 / M)) * F.cos(acc + F.lit(float(phase[m]))))
    others = [c for c in rows.columns if c != feature_col]
    return rows.select(*others, F.array(*zs).alias(out_col))


def poly_monomials(n_features: int, degree: int) -> list[tuple[int, ...]]:
    """Exponent vectors with total degree ``degree`` (lexicographic, highest power of x0 first)."""
    out = []
    for combo in itertools.combinations_with_replacement(range(n_features), degree):
        alpha = [0] * n_features
        for j in combo:
            alpha[j] += 1
        out.append(tuple(alpha))
    return out


def poly_coefficients(monos, degree: int, gamma: float) -> list[float]:
    return [math.sqrt((gamma ** degree) * math.factorial(degree) / math.prod(math.factorial(a) for a in alpha)) for alpha in monos]


def poly_transform(rows: DataFrame, n_features: int, degree: int, gamma: float, feature_col: str = "features", out_col: str = "features") -> DataFrame:
    """Explicit feature map with ``phi(x).phi(x') = (gamma x.x')^degree`` (degree 0: constant 1)."""
    monos = poly_monomials(n_features, degree)
    coefs = poly_coefficients(monos, degree, gamma)
    xs = [F.element_at(feature_col, j + 1) for j in range(n_features)]
    cols = []
    for alpha, c in zip(monos, coefs):
        term = F.lit(float(c))
        for j, a in enumerate(alpha):
            for _ in range(a):
                term = term * xs[j]
        cols.append(term)
    others = [c for c in rows.columns if c != feature_col]
    return rows.select(*others, F.array(*cols).alias(out_col))


# ---------------------------------------------------------------- Platt scaling
def fold_of(folds: int, seed: int) -> Column:
    """The fold of a row, drawn by a hash of its key."""
    return F.floor(hash_uniform(seed, F.lit("fold"), F.col("key")) * F.lit(float(folds))).cast("int")


def out_of_fold_scores(rows: DataFrame, cands: list[dict], n_features: int, n_steps: int, lr: float = 0.5,
                       kind: str = "svc", folds: int = 3, seed: int = 0, feature_col: str = "features") -> DataFrame:
    """``(trial_id, key, label, score)`` of every training row by a model that has not seen it. The
    models of all folds are fitted in the same passes."""
    maps = FeatureMaps(n_features)
    train = cut_lineage(rows.filter(F.col("split") == "train").select("key", F.col(feature_col).alias("features"), "label", fold_of(folds, seed).alias("fold")))
    fits = [f for f in new_fits([dict(c, kernel="linear") for c in cands], maps, folds) if f.held_out >= 0]
    fits = fit_steps(_linear_table(train, "features", F.col("fold")), fits, maps, n_steps, lr, kind)
    out = None
    for k in range(folds):
        held = batch_scores(train.filter(F.col("fold") == k), [f for f in fits if f.held_out == k], maps, ("key", "label"))
        out = held if out is None else out.unionByName(held)
    return out


def platt_scaling(scores: DataFrame, n_steps: int = 2, sigma: float = 1e-12) -> dict:
    """Fit ``P(y=1|f) = 1 / (1 + exp(A f + B))`` per trial by Newton steps (no line search).

    ``scores``: ``(trial_id, label, score)``. One aggregate job per step for all trials.
    """
    cnt = {r["trial_id"]: (r["npos"], r["nneg"]) for r in scores.groupBy("trial_id").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("npos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("nneg")).collect()}
    ab = {t: (0.0, math.log((nn + 1.0) / (np_ + 1.0))) for t, (np_, nn) in cnt.items()}
    for _ in range(n_steps):
        # per-trial parameters as a map literal (bounded by the batch size): O(1) lookup per row
        params = F.create_map(*[x for t, (a, b) in ab.items() for x in (
            F.lit(t), F.struct(F.lit(float(a)).alias("A"), F.lit(float(b)).alias("B"),
                               F.lit((cnt[t][0] + 1.0) / (cnt[t][0] + 2.0)).alias("hi"), F.lit(1.0 / (cnt[t][1] + 2.0)).alias("lo")))])
        x = scores.withColumn("_c", F.element_at(params, F.col("trial_id")))
        tt = F.when(F.col("label") == 1, F.col("_c.hi")).otherwise(F.col("_c.lo"))
        z = F.col("_c.A") * F.col("score") + F.col("_c.B")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(z))
        d1 = tt - p
        d2 = p * (F.lit(1.0) - p)
        g = x.groupBy("trial_id").agg(
            F.sum(F.col("score") * d1).alias("gA"), F.sum(d1).alias("gB"),
            F.sum(F.col("score") * F.col("score") * d2).alias("hAA"), F.sum(F.col("score") * d2).alias("hAB"),
            F.sum(d2).alias("hBB")).collect()
        for r in g:
            a, b = ab[r["trial_id"]]
            haa, hab, hbb = r["hAA"] + sigma, r["hAB"], r["hBB"] + sigma
            det = haa * hbb - hab * hab
            da = (hbb * r["gA"] - hab * r["gB"]) / det
            db = (-hab * r["gA"] + haa * r["gB"]) / det
            ab[r["trial_id"]] = (a - da, b - db)
    return ab
