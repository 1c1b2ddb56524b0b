"""Kernel feature maps in NumPy and the batch fit of support vector models over them.

All candidates of a batch, of whatever kernel, gamma, degree and C, share each pass over the rows:
the directions of the rbf map are drawn once and scaled by ``sqrt(gamma)``, the polynomial map of
a degree is scaled by ``gamma ** (degree / 2)``, and the gradients of all models are one packed vector
(``packed_sum``). The models of out-of-fold scores are further columns of the same passes.

A step asks of a row only whether its loss is active. For rbf maps that is told in float32 wherever the decision is
farther from the margin than a bound of its error, else in doubles row by row; the gradient of the step before is
changed by the (double precision) features of the rows whose answer has changed. While ``|w|_1`` and the offset bound all
decisions inside the margin, no row can have changed, and the model needs no pass.

* rbf: random Fourier features (Rahimi & Recht 2007)
* poly: monomials of the degree up to ``MAX_MONOMIALS`` of them, beyond that TensorSketch
  (Pham & Pagh 2013): count sketches of the input convolved by FFT, with seeded hashes
* linear: the features themselves
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.operators.packed import matrix, packed_rows, packed_sum, unpacked

#: Monomials listed one by one at most, and the length of the sketch used beyond.
MAX_MONOMIALS, SKETCH = 1024, 1024
SVR_EPSILON = 0.1
KERNELS = ("linear", "rbf", "poly")


def _u(seed: int, *parts) -> float:
    return int(hashlib.md5(":".join(str(p) for p in (seed, *parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def n_monomials(n_features: int, degree: int) -> int:
    return math.comb(n_features + degree - 1, degree) if degree else 1


def monomials(n_features: int, degree: int) -> list[tuple[int, ...]]:
    """Feature numbers of each monomial of the degree, with repeats, highest power of x0 first."""
    return list(itertools.combinations_with_replacement(range(n_features), degree))


def monomial_features(x: np.ndarray, degree: int) -> np.ndarray:
    """``phi(x).phi(y) = (x.y) ** degree`` by all monomials of the degree. Those of a degree that begin with
    feature j are x_j times those of the degree below that begin with j or a later feature."""
    d = x.shape[1]
    columns, power = np.ascontiguousarray(x.T), np.ones((1, len(x)))
    for lower in range(degree):
        starts = [n_monomials(d, lower) - n_monomials(d - j, lower) for j in range(d)]
        power = np.concatenate([columns[j] * power[start:] for j, start in enumerate(starts)])
    weights = []
    for combo in monomials(d, degree):
        repeats = [len(list(g)) for _, g in itertools.groupby(combo)]
        weights.append(math.sqrt(math.factorial(degree) / math.prod(math.factorial(r) for r in repeats)))
    power *= np.array(weights)[:, None]
    return power.T


#: 2 pi in parts (the first has 33 bits, so that its multiples are exact), and the series of (1 - cos s) / s**2.
_TURN = (float.fromhex("0x1.921fb5444p+2"), 2 * math.pi - float.fromhex("0x1.921fb5444p+2") + 2.4492935982947064e-16)
_SERIES = [(-1.0) ** k / math.factorial(2 * k + 2) for k in range(6)]


#: Up to here the reduction of :func:`cosine` is exact enough. The unit of float32, and what its cosine may be off by.
WIDE, UNIT, COSINE_OFF = 1e5, 2.0**-24, 1e-6


def cosine(t: np.ndarray) -> np.ndarray:
    """``cos(t)`` in place, to about 1e-15, several times faster than the double precision of NumPy: reduced
    to an eighth of half a turn, a series of ``1 - cos``, and three times ``1 - cos 2s = 2 v (2 - v)``."""
    if not t.size or not np.abs(t).max() < WIDE:
        return np.cos(t, out=t)
    k = np.multiply(t, 0.5 / math.pi)
    np.rint(k, out=k)
    v = np.multiply(k, _TURN[0])
    t -= v
    t -= np.multiply(k, _TURN[1], out=v)
    t *= 0.125
    np.multiply(t, t, out=t)
    np.multiply(t, _SERIES[5], out=v)
    for c in _SERIES[4:0:-1]:
        v += c
        v *= t
    v += _SERIES[0]
    v *= t
    for _ in range(3):
        np.subtract(2.0, v, out=t)
        v *= t
        v *= 2.0
    return np.subtract(1.0, v, out=t)


def sketch_hashes(n_features: int, degree: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each factor of the product: the bucket and the sign of each feature."""
    at = [[int(_u(seed, "h", f, j) * size) for j in range(n_features)] for f in range(degree)]
    sign = [[1.0 if _u(seed, "s", f, j) < 0.5 else -1.0 for j in range(n_features)] for f in range(degree)]
    return np.array(at), np.array(sign)


def tensor_sketch(x: np.ndarray, at: np.ndarray, sign: np.ndarray, size: int) -> np.ndarray:
    """Features whose dot products estimate ``(x.y) ** degree`` without bias; the mean squared error is
    at most ``(2 + 3 ** degree) / size * |x| ** (2 degree) * |y| ** (2 degree)``."""
    product = None
    for a, s in zip(at, sign, strict=True):
        count = np.zeros((x.shape[1], size))
        count[np.arange(x.shape[1]), a] = s
        spectrum = np.fft.rfft(x @ count, axis=1)
        product = spectrum if product is None else product * spectrum
    return np.fft.irfft(product, n=size, axis=1)


@dataclass
class FeatureMaps:
    """The maps of a batch: one for each (kernel, gamma or degree), computed from one draw."""

    n_features: int
    n_components: int = 64
    seed: int = 0
    sketch: int = SKETCH
    max_monomials: int = MAX_MONOMIALS
    _made: dict = field(default_factory=dict, repr=False)

    def key(self, cand: dict) -> tuple:
        kernel = cand.get("kernel", "rbf")
        if kernel not in KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}")
        gamma = float(cand.get("gamma", 5))
        return ("linear",) if kernel == "linear" else ("rbf", gamma) if kernel == "rbf" else ("poly", int(cand.get("degree", 3)), gamma)

    def size(self, key: tuple) -> int:
        if key[0] == "linear":
            return self.n_features
        if key[0] == "rbf":
            return self.n_components
        exact = n_monomials(self.n_features, key[1])
        return exact if exact <= self.max_monomials else self.sketch

    def _draw(self, name):
        if name not in self._made:
            d, m = self.n_features, self.n_components
            if name == "rbf":
                normal = [[math.sqrt(-2.0 * math.log(1.0 - _u(self.seed, "w1", k, j))) * math.cos(2.0 * math.pi * _u(self.seed, "w2", k, j)) for j in range(d)] for k in range(m)]
                self._made[name] = np.array(normal).reshape(m, d), np.array([2.0 * math.pi * _u(self.seed, "b", k) for k in range(m)])
            else:
                self._made[name] = sketch_hashes(d, name, self.sketch, self.seed)
        return self._made[name]

    def prepare(self, keys) -> FeatureMaps:
        """Draw on the driver, so that tasks get the numbers and do not draw again."""
        for key in keys:
            if key[0] == "rbf":
                self._draw("rbf")
            elif key[0] == "poly" and self.size(key) != n_monomials(self.n_features, key[1]):
                self._draw(key[1])
        return self

    def rough(self, x: np.ndarray, keys: list[tuple]) -> Iterator[tuple[tuple, np.ndarray, float]]:
        """Each rbf key with ``cos(t)`` of the rows in float32, and a bound of its error."""
        normal, phase = self._draw("rbf")
        projected = x.astype(np.float32) @ normal.T.astype(np.float32)
        reach = np.abs(normal).sum(axis=1).max() * np.abs(x).max()
        for key in keys:
            g = math.sqrt(2.0 * key[1])
            t = projected * np.float32(g)
            t += phase.astype(np.float32)
            yield key, np.cos(t, out=t), (self.n_features + 8) * UNIT * (g * reach + 2.0 * math.pi) + COSINE_OFF

    def by_row(self, x: np.ndarray, key: tuple) -> np.ndarray:
        """The rbf features, the same bits for a row among whatever others."""
        normal, phase = self._draw("rbf")
        t = np.zeros((len(x), self.n_components))
        for j in range(self.n_features):
            t += x[:, j : j + 1] * normal[:, j]
        t *= math.sqrt(2.0 * key[1])
        t += phase
        wide = ~(np.abs(t).max(axis=1) < WIDE) if len(t) else np.zeros(0, bool)
        z = np.empty_like(t)
        z[~wide], z[wide] = cosine(t[~wide]), np.cos(t[wide])
        z *= math.sqrt(2.0 / self.n_components)
        return z

    def features(self, x: np.ndarray, keys: list[tuple]) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each key with the rows' features; what keys share is computed once, one matrix is held."""
        projected, degree, power = None, None, None
        for key in sorted(keys):
            if key[0] == "linear":
                yield key, x
            elif key[0] == "rbf":
                normal, phase = self._draw("rbf")
                projected = x @ normal.T if projected is None else projected
                z = np.multiply(projected, math.sqrt(2.0 * key[1]))
                z += phase
                cosine(z)
                z *= math.sqrt(2.0 / self.n_components)
                yield key, z
            else:
                if degree != key[1]:
                    degree = key[1]
                    exact = n_monomials(self.n_features, degree) <= self.max_monomials
                    power = monomial_features(x, degree) if exact else tensor_sketch(x, *self._draw(degree), self.sketch)
                yield key, key[2] ** (degree / 2.0) * power


@dataclass
class Fit:
    """Weights of one model: ``w`` over the features of its map, and the offset."""

    trial_id: int
    key: tuple
    C: float
    held_out: int = -1  # the fold of rows that it has not seen; -1: none
    w: np.ndarray | None = None
    b: float = 0.0


def new_fits(cands: list[dict], maps: FeatureMaps, folds: int = 0) -> list[Fit]:
    """A model for each candidate, and one for each fold of it."""
    return [Fit(c["trial_id"], k := maps.key(c), float(c["C"]), f, np.zeros(maps.size(k))) for c in cands for f in (-1, *range(folds))]


def _groups(fits: list[Fit]) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for i, f in enumerate(fits):
        out.setdefault(f.key, []).append(i)
    return out


#: Numbers of one map that are held at once: its passes stay in a core's own cache.
CACHED = 32_768


def packed_folds(train: DataFrame, n_features: int) -> DataFrame:
    """The blocks of a table (features, label, fold); a table of blocks is left as it is."""
    return train if "x" in train.columns else packed_rows(train, n_features, ("label", "fold"))


def _values(batch: pa.RecordBatch, maps: FeatureMaps, keys, others: tuple[str, ...] = ("label", "fold")) -> Iterator[tuple[np.ndarray, ...]]:
    """Features and other columns, by as many rows as a map's features fit the cache for."""
    step = max(32, CACHED // max(map(maps.size, keys)))
    for block in unpacked(batch, maps.n_features, others):
        for at in range(0, len(block[0]), step):
            yield tuple(v[at : at + step] for v in block)


def rough_decisions(x: np.ndarray, weights: dict[tuple, tuple[np.ndarray, np.ndarray]], maps: FeatureMaps) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """``{key: (decisions [rows, models], bounds of their error [models])}`` of rbf models, computed in float32."""
    scale, units = math.sqrt(2.0 / maps.n_components), (maps.n_components + 8) * UNIT
    narrow = {key: (scale * w).astype(np.float32) for key, (w, _) in weights.items()}
    norms = {key: scale * np.abs(w).sum(axis=0) for key, (w, _) in weights.items()}
    found = {key: (np.empty((len(x), w.shape[1])), np.zeros(w.shape[1])) for key, (w, _) in weights.items()}
    step = max(32, CACHED // maps.n_components)
    for at in range(0, len(x), step):
        for key, z, off in maps.rough(x[at : at + step], list(weights)):
            f, err = found[key]
            f[at : at + step] = z @ narrow[key]
            np.maximum(err, norms[key] * (off + units) + 8 * UNIT * norms[key], out=err)
    for f, _ in found.values():
        f[~np.isfinite(f)] = np.nan  # beyond float32: nothing is known
    return {key: (f + weights[key][1], err + 1e-9 * np.abs(weights[key][1]) + 1e-30) for key, (f, err) in found.items()}


def _sure(x: np.ndarray, key: tuple, maps: FeatureMaps, w: np.ndarray, b: np.ndarray, f: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """``f`` with the decisions of unsure rows in doubles."""
    for at in np.array_split(np.flatnonzero(unsure.any(axis=1)), max(1, int(unsure.any(axis=1).sum()) * maps.n_components // CACHED)):
        if len(at):
            z = maps.by_row(x[at], key)
            exact = np.stack([(z * np.ascontiguousarray(w[:, c])).sum(axis=1) + b[c] for c in range(w.shape[1])], axis=1)
            f[at] = np.where(unsure[at], exact, f[at])
    return f


def _active(f: np.ndarray, y: np.ndarray, kind: str, eps: float) -> np.ndarray:
    """The subgradient of each row's loss by its decision, up to the sign: [rows, models]."""
    if kind == "svc":
        sign = (2.0 * y - 1.0)[:, None]
        return np.where(sign * f < 1.0, sign, 0.0)
    r = f - y[:, None]
    return np.where(np.abs(r) > eps, np.sign(r), 0.0)


def _unsure(f: np.ndarray, err: np.ndarray, y: np.ndarray, kind: str, eps: float) -> np.ndarray:
    """Where a decision lies so near to the margin that an error of ``err`` may change :func:`_active`."""
    if kind == "svc":
        sign = (2.0 * y - 1.0)[:, None]
        return ~(np.abs(sign * f - 1.0) > np.abs(sign) * err)
    return ~(np.abs(np.abs(f - y[:, None]) - eps) > err)


def fit_steps(train: DataFrame, fits: list[Fit], maps: FeatureMaps, n_steps: int, lr: float = 0.5, kind: str = "svc", eps: float = SVR_EPSILON) -> list[Fit]:
    """Full-batch subgradient steps of all models, at most ONE job a step whatever kernels they have.

    ``train``: (features, label, fold), or the blocks of :func:`packed_folds`, written once for all steps.
    Step t uses ``eta = lr / (1 + t)`` and ``lambda = 1 / (C n)``, n being the rows that the model sees."""
    groups = _groups(fits)
    maps.prepare(groups)
    train, last = packed_folds(train, maps.n_features), max(f.held_out for f in fits) + 1

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, y, fold in unpacked(batch, maps.n_features, ("label", "fold")):
            total[:-1] += np.bincount(np.where((fold >= 0) & (fold < last), fold, last).astype(int), minlength=last + 1)
            total[-1] += (~((y == 0) | (y == 1))).sum()

    *counts, odd = packed_sum(train, count, last + 2)
    n_rows = [int(sum(counts) - (counts[f.held_out] if f.held_out >= 0 else 0)) for f in fits]
    held = {key: np.array([fits[i].held_out for i in some]) for key, some in groups.items()}
    sums = {key: np.zeros((maps.size(key) + 1, len(some))) for key, some in groups.items()}  # by the weights of `before`
    before: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def inside(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Models of an rbf map that put no row at the margin or beyond it, whatever its features are."""
        return math.sqrt(2.0 / maps.n_components) * np.abs(w).sum(axis=0) + np.abs(b) < 1.0 - 1e-9

    for t in range(n_steps):
        state = {key: (np.stack([fits[i].w for i in some], axis=1), np.array([fits[i].b for i in some])) for key, some in groups.items()}
        whole = {key: state[key] for key in groups if t == 0 or key[0] != "rbf"}
        moved = {}  # columns of the models whose active rows may have changed
        for key in groups.keys() - whole.keys():
            still = inside(*state[key]) & inside(*before[key]) if kind == "svc" and not odd else np.zeros(len(groups[key]), bool)
            if not still.all():
                moved[key] = np.flatnonzero(~still)
        spans, size = {}, 0
        for key in [*whole, *sorted(moved)]:
            spans[key] = size
            size += (maps.size(key) + 1) * (len(moved[key]) if key in moved else len(groups[key]))
        both = {key: (np.concatenate([before[key][0][:, c], state[key][0][:, c]], axis=1), np.concatenate([before[key][1][c], state[key][1][c]])) for key, c in moved.items()}

        def add(batch: pa.RecordBatch, total: np.ndarray, whole=whole, moved=moved, both=both, spans=spans) -> None:
            def put(key: tuple, z: np.ndarray, coef: np.ndarray) -> None:
                own = total[spans[key] : spans[key] + (z.shape[1] + 1) * coef.shape[1]].reshape(z.shape[1] + 1, -1)
                own[:-1] += z.T @ coef
                own[-1] += coef.sum(axis=0)

            if whole:
                for x, y, fold in _values(batch, maps, whole):
                    for key, z in maps.features(x, list(whole)):
                        w, b = whole[key]
                        put(key, z, _active(z @ w + b, y, kind, eps) * (fold[:, None] != held[key][None, :]))
            if moved:
                for x, y, fold in unpacked(batch, maps.n_features, ("label", "fold")):
                    for key, (f, err) in rough_decisions(x, both, maps).items():
                        f = _sure(x, key, maps, *both[key], f, _unsure(f, err, y, kind, eps))
                        coef, n = _active(f, y, kind, eps), len(moved[key])
                        change = (coef[:, n:] - coef[:, :n]) * (fold[:, None] != held[key][None, moved[key]])
                        rows = np.flatnonzero(change.any(axis=1))
                        for at in range(0, len(rows), max(32, CACHED // maps.n_components)):
                            some = rows[at : at + max(32, CACHED // maps.n_components)]
                            put(key, maps.by_row(x[some], key), change[some])

        total = packed_sum(train, add, size) if size else np.zeros(0)
        eta, toward = lr / (1.0 + t), 1.0 if kind == "svc" else -1.0
        for key, some in groups.items():
            if key in spans:
                own = total[spans[key] : spans[key] + (maps.size(key) + 1) * (len(moved[key]) if key in moved else len(some))].reshape(maps.size(key) + 1, -1)
                if key in moved:
                    sums[key][:, moved[key]] += own
                else:
                    sums[key] = own
            for k, i in enumerate(some):
                f, n = fits[i], max(n_rows[i], 1)
                lam = 1.0 / (f.C * n)
                f.w = f.w - eta * (lam * f.w - toward * sums[key][:-1, k] / n)
                f.b = f.b + eta * toward * sums[key][-1, k] / n
        before = state
    return fits


def _decisions(x: np.ndarray, fits: list[Fit], maps: FeatureMaps) -> np.ndarray:
    """[rows, fits]"""
    groups = _groups(fits)
    out = np.empty((len(x), len(fits)))
    for key, z in maps.features(x, list(groups)):
        out[:, groups[key]] = z @ np.stack([fits[i].w for i in groups[key]], axis=1) + np.array([fits[i].b for i in groups[key]])
    return out


def batch_scores(rows: DataFrame, fits: list[Fit], maps: FeatureMaps, keep: tuple[str, ...] = ("key", "label", "split")) -> DataFrame:
    """``(trial_id, *keep, score)``: the decision of every model on every row, in one pass."""
    maps.prepare({f.key for f in fits})
    trials = np.array([f.trial_id for f in fits], np.int64)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), max(1, 500_000 // max(len(fits), 1))):
                some = batch.slice(at, max(1, 500_000 // max(len(fits), 1)))
                scores = _decisions(matrix(some.column("features"), maps.n_features), fits, maps)
                take = pa.array(np.tile(np.arange(len(some)), len(fits)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(trials, len(some))), *(some.column(c).take(take) for c in keep), pa.array(scores.T.ravel())], names=["trial_id", *keep, "score"])

    return rows.select(*keep, "features").mapInArrow(run, "trial_id bigint, " + ", ".join(f"{c} {fields[c]}" for c in keep) + ", score double")


def batch_costs(rows: DataFrame, fits: list[Fit], maps: FeatureMaps, score: str) -> dict[int, float]:
    """``{trial_id: cost}`` over packed rows ``(x, label)``: RMSE, or one less the accuracy of the decision's sign (told in
    float32 where that is sure). The decisions are summed in the pass; without rows there are no costs."""
    maps.prepare(keys := {f.key for f in fits})
    rbf = {key: (np.stack([fits[i].w for i in some], axis=1), np.array([fits[i].b for i in some])) for key, some in _groups(fits).items() if key[0] == "rbf" and score != "rmse"}
    groups, others = _groups(fits), [i for i, f in enumerate(fits) if f.key not in rbf]

    def signs(x: np.ndarray) -> np.ndarray:
        f = np.empty((len(x), len(fits)))
        if others:
            f[:, others] = _decisions(x, [fits[i] for i in others], maps)
        for key, (own, err) in (rough_decisions(x, rbf, maps) if rbf else {}).items():
            f[:, groups[key]] = _sure(x, key, maps, *rbf[key], own, ~(np.abs(own) > err))
        return ~(f <= 0)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for x, y in _values(batch, maps, keys, ("label",)):
            error = (y[:, None] - _decisions(x, fits, maps)) ** 2 if score == "rmse" else y[:, None] == signs(x)
            total[:-1] += error.sum(axis=0)
            total[-1] += len(y)

    *sums, n = packed_sum(rows, add, len(fits) + 1)
    return {f.trial_id: math.sqrt(s / n) if score == "rmse" else float(1.0 - s / n) for f, s in zip(fits, sums, strict=True)} if n else {}


def platt_steps(train: DataFrame, fits: list[Fit], maps: FeatureMaps, n_steps: int, sigma: float = 1e-12) -> dict[int, tuple[float, float]]:
    """``{trial_id: (A, B)}`` of ``P(y=1|f) = 1 / (1 + exp(A f + B))``, by Newton steps on the scores that
    each row gets from the model of its fold. Scores are made in the pass and never written."""
    folds = [f for f in fits if f.held_out >= 0]
    trials = sorted({f.trial_id for f in folds})
    number = {t: i for i, t in enumerate(trials)}
    n_folds = max(f.held_out for f in folds) + 1
    order = np.full((len(trials), n_folds), -1)
    for i, f in enumerate(folds):
        order[number[f.trial_id], f.held_out] = i
    maps.prepare({f.key for f in folds})

    keys, train = {f.key for f in folds}, packed_folds(train, maps.n_features)

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y, fold in _values(batch, maps, keys):
            yield np.take_along_axis(_decisions(x, folds, maps), order.T[fold.astype(int)], axis=1), y

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, y, _ in unpacked(batch, maps.n_features, ("label", "fold")):
            total += ((y == 1).sum(), (y != 1).sum())

    pos, neg = packed_sum(train, count, 2)
    high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)
    a, b = np.zeros(len(trials)), np.full(len(trials), math.log((neg + 1.0) / (pos + 1.0)))
    for _ in range(n_steps):
        def add(batch: pa.RecordBatch, total: np.ndarray, a=a, b=b) -> None:
            for f, y in scores(batch):
                target = np.where(y == 1, high, low)[:, None]
                p = 1.0 / (1.0 + np.exp(a * f + b))
                d1, d2 = target - p, p * (1.0 - p)
                total += np.concatenate([s.sum(axis=0) for s in (f * d1, d1, f * f * d2, f * d2, d2)])

        ga, gb, haa, hab, hbb = packed_sum(train, add, 5 * len(trials)).reshape(5, -1)
        haa, hbb = haa + sigma, hbb + sigma
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (-hab * ga + haa * gb) / det
    return {t: (float(a[i]), float(b[i])) for t, i in number.items()}
