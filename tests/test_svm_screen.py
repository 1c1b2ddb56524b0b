"""Steps of rbf models whose rows are told in float32: the same weights as plain steps, with far fewer cosines in doubles."""

import numpy as np
import pyarrow as pa
import pytest

from tests.test_svm import plain_features, plain_steps
from tuneforge.operators import kernels


class Blocks:
    """A table of blocks whose passes run here, one after the other."""

    columns = ["x"]

    def __init__(self, x, y, fold, size=500):
        parts = [slice(i, i + size) for i in range(0, len(x), size)]
        self.batches = [pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v[p], float).tobytes()]) for v in (x, y, fold)], names=["x", "label", "fold"]) for p in parts]


@pytest.fixture
def here(monkeypatch):
    """Passes, and the cosines computed in doubles."""
    seen = {"passes": 0, "cosines": 0}

    def packed_sum(blocks, add, size):
        seen["passes"] += 1
        total = np.zeros(size)
        for b in blocks.batches:
            add(b, total)
        return total

    cosine = kernels.cosine
    monkeypatch.setattr(kernels, "packed_sum", packed_sum)
    monkeypatch.setattr(kernels, "cosine", lambda t: seen.update(cosines=seen["cosines"] + t.size) or cosine(t))
    return seen


@pytest.mark.parametrize("kind", ["svc", "svr"])
@pytest.mark.parametrize("far", [1.0, 1e7])
def test_rows_beyond_the_margin(here, kind, far):
    """Large steps: rows cross the margin to and fro. Features of 1e7 leave nothing to float32."""
    rng = np.random.default_rng(7)
    x = rng.random((1000, 3))
    x[:200] = x[0]  # many rows alike, which are at the margin together
    x[990:] *= far
    y, fold = (x[:, 0] > 0.4).astype(float), rng.integers(0, 3, 1000)
    if kind == "svr":
        y = 2 * x[:, 1] % 3
    cands = [{"trial_id": i, "kernel": "rbf", "gamma": g, "C": c} for i, (g, c) in enumerate([(0.4, 1.0), (2.0, 0.01), (2.0, 10.0), (9.0, 1.0)])]
    maps = kernels.FeatureMaps(3)
    fits = kernels.fit_steps(Blocks(x, y, fold), kernels.new_fits(cands, maps, 3), maps, 15, 6.0, kind)
    for f in fits:
        w, b = plain_steps(plain_features(x, cands[f.trial_id]), y, f.C, 15, 6.0, kind, fold != f.held_out)
        assert np.allclose(f.w, w, atol=1e-7 if far > 1 else 1e-9) and abs(f.b - b) < 1e-9
    assert here["passes"] == 16


def test_labels_that_are_no_classes(here):
    """No row is taken to be inside the margin where labels are others than 0 and 1."""
    x, rng = np.random.default_rng(1).random((400, 2)), np.random.default_rng(2)
    y = rng.choice([0.0, 1.0, 4.0], 400)
    maps, cand = kernels.FeatureMaps(2), {"trial_id": 0, "kernel": "rbf", "gamma": 3.0, "C": 1.0}
    fit, = kernels.fit_steps(Blocks(x, y, np.zeros(400)), kernels.new_fits([cand], maps), maps, 8)
    w, b = plain_steps(plain_features(x, cand), y, 1.0, 8, 0.5, "svc", np.ones(400, bool))
    assert np.allclose(fit.w, w, atol=1e-9) and abs(fit.b - b) < 1e-9


@pytest.mark.parametrize("lr", [0.5, 3.0])
def test_few_cosines_in_doubles(here, lr):
    """fit_svm_rbf: twenty steps took twenty times the cosines of all rows; now those of one step and of rows that change."""
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.random(4000) > 0.75).astype(float)
    cands = [{"trial_id": i, "kernel": "rbf", "gamma": g, "C": 1.0} for i, g in enumerate([0.1, 0.7, 3.0, 10.0])]
    maps = kernels.FeatureMaps(4)
    fits = kernels.fit_steps(Blocks(x, y, np.zeros(4000)), kernels.new_fits(cands, maps), maps, 20, lr)
    assert here["cosines"] < 4 * 4000 * 64 * (1.01 if lr < 1 else 7)
    for f in fits:
        w, b = plain_steps(plain_features(x, cands[f.trial_id]), y, 1.0, 20, lr, "svc", np.ones(4000, bool))
        assert np.allclose(f.w, w, atol=1e-9) and abs(f.b - b) < 1e-9
    here["cosines"] = 0
    blocks = Blocks(x, y, np.zeros(4000))
    costs = kernels.batch_costs(blocks, fits, maps, "acc")
    assert here["cosines"] < 4 * 4000 * 64 * 0.05
    for f in fits:
        d = plain_features(x, cands[f.trial_id]) @ f.w + f.b
        assert costs[f.trial_id] == pytest.approx(1 - ((d > 0) == y).mean(), abs=1e-12)


def test_odd_features(here):
    """A feature that is not a number spoils its model as before; an infinite one too."""
    for odd in (np.nan, np.inf):
        x = np.random.default_rng(4).random((50, 2))
        x[7, 1] = odd
        maps, cand = kernels.FeatureMaps(2), {"trial_id": 0, "kernel": "rbf", "gamma": 3.0, "C": 1.0}
        fit, = kernels.fit_steps(Blocks(x, x[:, 0] > 0.5, np.zeros(50)), kernels.new_fits([cand], maps), maps, 4)
        assert np.isnan(fit.w).all()


def test_other_kernels_share_the_steps(here):
    """search_random_svm: linear and polynomial models take each step over all rows, rbf models of the batch do not."""
    rng = np.random.default_rng(9)
    x = rng.random((3000, 4))
    y = (x.sum(axis=1) + 0.4 * rng.random(3000) > 2.2).astype(float)
    cands = [{"trial_id": 0, "kernel": "linear", "C": 1.0}, {"trial_id": 1, "kernel": "poly", "gamma": 0.5, "degree": 2, "C": 1.0}, {"trial_id": 2, "kernel": "poly", "gamma": 0.3, "degree": 3, "C": 0.1},
             {"trial_id": 3, "kernel": "rbf", "gamma": 0.2, "C": 1.0}, {"trial_id": 4, "kernel": "rbf", "gamma": 4.0, "C": 5.0}]
    maps = kernels.FeatureMaps(4)
    fits = kernels.fit_steps(Blocks(x, y, np.zeros(3000)), kernels.new_fits(cands, maps), maps, 20, 2.0)
    assert here["passes"] == 21 and here["cosines"] < 2 * 3000 * 64 * 6
    for f in fits:
        w, b = plain_steps(plain_features(x, cands[f.trial_id]), y, f.C, 20, 2.0, "svc", np.ones(3000, bool))
        assert np.allclose(f.w, w, atol=1e-9) and abs(f.b - b) < 1e-9
