"""One-hidden-layer perceptron fitted for a whole candidate batch (the ``mlp`` estimator).

Rows are dealt into shards by a hash of their key, one for each ``SHARD_ROWS`` rows unless a number
is given: the number is part of the result's definition. A shard is packed into one row of a table that is
written and dealt to the tasks once. Each epoch is ONE Spark job: a task takes its shards' rows in
the order of a per-epoch hash of the key and runs mini-batch gradient descent for every candidate from
the epoch's global weights; the row-weighted mean of the shards' parameters (``packed_sum``: partitions
first, then the partial sums) gives the next global weights (parameter averaging). The same job
scores the incoming weights on the validation rows.

NumPy runs inside tasks only. A task's shards (a bounded number) are trained side by side: they start from the same
state, so step t of all of them is one product of stacked matrices. With one shard this is exactly sequential mini-batch training. Results do not depend on
partitions or cores, but for the last digits of sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.functions.hashing import md5_heads
from tuneforge.operators.packed import packed_sum
from tuneforge.operators.space import DEFAULT_SPACES
from tuneforge.session import cut_lineage

# ---- fixed values: optimiser constants (Keras defaults) ----
ADAM_B1, ADAM_B2, EPS = 0.9, 0.999, 1e-7
RMS_RHO, ADADELTA_RHO = 0.9, 0.95
# ---- end of fixed values ----
#: Rows of a shard, and tasks of an epoch at most (beyond, a task takes several shards).
SHARD_ROWS, MAX_TASKS = 8192, 10_000
#: Shards that a task trains side by side at most, and bytes of their rows.
SIDE_BY_SIDE, TASK_BYTES = 32, 64_000_000


def _act(name, z):
    if name == "relu":
        return np.maximum(z, 0.0)
    if name == "sigmoid":
        return 1.0 / (1.0 + np.exp(-z))
    return np.tanh(z)


def _dact(name, z, a):
    if name == "relu":
        return (z > 0).astype(float)
    if name == "sigmoid":
        return a * (1.0 - a)
    return 1.0 - a * a


def n_slots(opt: str) -> int:
    return {"sgd": 0, "RMSprop": 1, "adam": 2, "adamax": 2, "nadam": 2, "adadelta": 2}[opt]


def param_size(d: int, h: int) -> int:
    return d * h + h + h + 1


def unpack(vec: np.ndarray, d: int, h: int):
    i = 0
    W1 = vec[i:i + d * h].reshape(d, h); i += d * h
    b1 = vec[i:i + h]; i += h
    W2 = vec[i:i + h]; i += h
    b2 = vec[i:i + 1]
    return W1, b1, W2, b2


def init_params(trial_id: int, d: int, h: int, seed: int) -> np.ndarray:
    """Glorot-uniform kernels, zero biases; seeded by (seed, trial_id)."""
    rng = np.random.default_rng([seed, int(trial_id)])
    l1 = math.sqrt(6.0 / (d + h))
    l2 = math.sqrt(6.0 / (h + 1))
    return np.concatenate([rng.uniform(-l1, l1, d * h), np.zeros(h), rng.uniform(-l2, l2, h), np.zeros(1)])


def forward(vec, X, d, h, a1, a2):
    W1, b1, W2, b2 = unpack(vec, d, h)
    z1 = X @ W1 + b1
    H = _act(a1, z1)
    z2 = H @ W2 + b2[0]
    return z1, H, z2, _act(a2, z2)


def loss_value(loss: str, y, p):
    if loss == "binary_crossentropy":
        q = np.clip(p, EPS, 1 - EPS)
        return -(y * np.log(q) + (1 - y) * np.log(1 - q))
    return (p - y) ** 2


def gradient(vec, X, y, d, h, a1, a2, loss):
    """Mean-loss gradient over a batch (backprop for one hidden layer)."""
    return loss_and_gradient(vec, X, y, d, h, a1, a2, loss)[1]


def loss_and_gradient(vec, X, y, d, h, a1, a2, loss):
    """(summed batch loss, mean-loss gradient) from one forward pass."""
    z1, H, z2, p = forward(vec, X, d, h, a1, a2)
    n = len(y)
    total = float(loss_value(loss, y, p).sum())
    if loss == "binary_crossentropy":
        q = np.clip(p, EPS, 1 - EPS)
        dp = (q - y) / (q * (1 - q))
        dp = np.where((p > EPS) & (p < 1 - EPS), dp, 0.0)
    else:
        dp = 2.0 * (p - y)
    dz2 = dp * _dact(a2, z2, p) / n
    W1, b1, W2, b2 = unpack(vec, d, h)
    gW2 = H.T @ dz2
    gb2 = np.array([dz2.sum()])
    dz1 = np.outer(dz2, W2) * _dact(a1, z1, H)
    gW1 = X.T @ dz1
    gb1 = dz1.sum(axis=0)
    return total, np.concatenate([gW1.ravel(), gb1, gW2, gb2])


def step(opt: str, lr: float, w, slots, t: int, g):
    """One optimiser update; ``t`` is the 1-based update count; returns (w, slots)."""
    if opt == "sgd":
        return w - lr * g, slots
    if opt == "RMSprop":
        v = RMS_RHO * slots[0] + (1 - RMS_RHO) * g * g
        return w - lr * g / (np.sqrt(v) + EPS), [v]
    if opt in ("adam", "nadam"):
        m = ADAM_B1 * slots[0] + (1 - ADAM_B1) * g
        v = ADAM_B2 * slots[1] + (1 - ADAM_B2) * g * g
        vh = v / (1 - ADAM_B2 ** t)
        if opt == "adam":
            mh = m / (1 - ADAM_B1 ** t)
        else:  # Nesterov-accelerated (Dozat 2016)
            mh = ADAM_B1 * m / (1 - ADAM_B1 ** (t + 1)) + (1 - ADAM_B1) * g / (1 - ADAM_B1 ** t)
        return w - lr * mh / (np.sqrt(vh) + EPS), [m, v]
    if opt == "adamax":
        m = ADAM_B1 * slots[0] + (1 - ADAM_B1) * g
        u = np.maximum(ADAM_B2 * slots[1], np.abs(g))
        return w - (lr / (1 - ADAM_B1 ** t)) * m / (u + EPS), [m, u]
    if opt == "adadelta":
        ag = ADADELTA_RHO * slots[0] + (1 - ADADELTA_RHO) * g * g
        dx = np.sqrt(slots[1] + EPS) / np.sqrt(ag + EPS) * g
        ax = ADADELTA_RHO * slots[1] + (1 - ADADELTA_RHO) * dx * dx
        return w - lr * dx, [ag, ax]
    raise ValueError(f"unknown optimizer {opt!r}")


def stacked_gradient(W: np.ndarray, X: np.ndarray, y: np.ndarray, d, h, a1, a2, loss) -> tuple[np.ndarray, np.ndarray]:
    """:func:`loss_and_gradient` of many models, each on its own batch: W [models, parameters], X [models, rows, d]."""
    n = y.shape[1]
    W1, b1, W2, b2 = W[:, : d * h].reshape(-1, d, h), W[:, None, d * h : d * h + h], W[:, d * h + h : d * h + 2 * h], W[:, -1:]
    z1 = X @ W1 + b1
    H = _act(a1, z1)
    z2 = (H @ W2[:, :, None])[:, :, 0] + b2
    p = _act(a2, z2)
    total = loss_value(loss, y, p).sum(axis=1)
    if loss == "binary_crossentropy":
        q = np.clip(p, EPS, 1 - EPS)
        dp = np.where((p > EPS) & (p < 1 - EPS), (q - y) / (q * (1 - q)), 0.0)
    else:
        dp = 2.0 * (p - y)
    dz2 = dp * _dact(a2, z2, p) / n
    dz1 = dz2[:, :, None] * W2[:, None, :] * _dact(a1, z1, H)
    parts = (X.transpose(0, 2, 1) @ dz1).reshape(len(W), -1), dz1.sum(axis=1), (H.transpose(0, 2, 1) @ dz2[:, :, None])[:, :, 0], dz2.sum(axis=1, keepdims=True)
    return total, np.concatenate(parts, axis=1)


def train_shards(c: dict, state, shards: list[tuple[np.ndarray, np.ndarray]], d: int) -> list[tuple]:
    """(parameters, slots, updates, loss) of a candidate after one pass over each shard (its training rows in
    order), from the same state. Whole batches are stacked over the shards that still have one; what a shard has left
    is its last batch."""
    w, slots, t0 = state
    size, h, opt, lr = int(c["batch_size"]), int(c["neurons"]), c["optimizer"], float(c["learning_rate"])
    names = c["hiddenactivation"], c["activation"], c["loss"]
    order = sorted(range(len(shards)), key=lambda i: -len(shards[i][1]))
    whole = [len(shards[i][1]) // size for i in order]
    X, y = np.zeros((len(shards), whole[0] * size, d)), np.zeros((len(shards), whole[0] * size))
    for k, i in enumerate(order):
        X[k, : whole[k] * size], y[k, : whole[k] * size] = (v[: whole[k] * size] for v in shards[i])
    W, S, loss = np.tile(w, (len(shards), 1)), [np.tile(s, (len(shards), 1)) for s in slots], np.zeros(len(shards))
    live = len(shards)
    for t in range(whole[0]):
        while whole[live - 1] <= t:
            live -= 1
        part, g = stacked_gradient(W[:live], X[:live, t * size : (t + 1) * size], y[:live, t * size : (t + 1) * size], d, h, *names)
        new, moved = step(opt, lr, W[:live], [s[:live] for s in S], t0 + t + 1, g)
        W[:live], loss[:live] = new, loss[:live] + part
        for s, m in zip(S, moved, strict=True):
            s[:live] = m
    out: list = [None] * len(shards)
    for k, i in enumerate(order):
        own, own_slots, t, total = W[k], [s[k] for s in S], t0 + whole[k], loss[k]
        Xo, yo = (v[whole[k] * size :] for v in shards[i])
        if len(yo):
            part, g = loss_and_gradient(own, Xo, yo, d, h, *names)
            own, own_slots = step(opt, lr, own, own_slots, t + 1, g)
            t, total = t + 1, total + part
        out[i] = own, own_slots, t, total
    return out


def _packed_shards(rows: DataFrame, n_shards: int, n_features: int = 1) -> DataFrame:
    """One row for each shard: keys, training flags, features and labels of its rows. Written once and
    dealt to the tasks once; an epoch ships nothing anew."""
    def pack(table: pa.Table) -> pa.Table:
        flat = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        y = table.column("label").to_numpy().astype(float)
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "keys": pa.array([table.column("key").to_pylist()], pa.list_(pa.string())), "train": pa.array([table.column("train").to_pylist()], pa.list_(pa.bool_())),
            "x": pa.array([np.ascontiguousarray(flat, float).tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

    shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
    src = rows.filter(F.col("split").isin("train", "val")).select(F.col("key").cast("string").alias("key"), "features", F.col("label").cast("double").alias("label"), (F.col("split") == "train").alias("train"), shard.alias("shard"))
    packed = cut_lineage(src.groupBy("shard").applyInArrow(pack, "shard int, keys array<string>, train array<boolean>, x binary, y binary"))
    # a task trains some shards side by side, as many as fit SIDE_BY_SIDE and TASK_BYTES, if all slots have work
    together = max(1, min(SIDE_BY_SIDE, TASK_BYTES // (8 * SHARD_ROWS * (n_features + 8))))
    tasks = min(n_shards, MAX_TASKS, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n_shards // together)))
    return packed.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks)))


def in_epoch_order(seed: int, epoch: int, keys: list[str] | pa.Array) -> np.ndarray:
    """The rows of a shard in the order of an epoch: by eight hex digits of an md5 of seed, epoch and key, then by key."""
    keys = (keys if isinstance(keys, pa.Array) else pa.array(keys, pa.string())).fill_null("None")
    drawn = md5_heads(keys, [f"{seed}:{epoch}:".encode()])[0]
    order = np.argsort(drawn, kind="stable")
    if (drawn[order][1:] == drawn[order][:-1]).any():
        names = keys.to_pylist()
        order = np.array(sorted(order.tolist(), key=lambda i: (int(drawn[i]), names[i], i)))
    return order


def _layout(cands: list[dict], d: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Where each candidate's numbers stand in the packed sum: the row-weighted parameters and optimiser
    slots, then update count, rows, training loss, validation loss, validation rows."""
    at, out = 0, {}
    for c in cands:
        size = param_size(d, int(c["neurons"])) * (1 + n_slots(c["optimizer"]))
        out[c["trial_id"]] = at, size
        at += size + 5
    return out, at


def _train_shards(shared, d: int, seed: int, epoch: int, places: dict[int, tuple[int, int]]):
    """Add the shards of a batch to the packed sum: each is trained through from the shared state."""
    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        train_c, val_c, state = shared.value
        together = max(1, min(SIDE_BY_SIDE, TASK_BYTES // (8 * SHARD_ROWS * (d + 8))))
        for at in range(0, len(batch), together):
            shards = []
            for row in range(at, min(at + together, len(batch))):
                flags = batch.column("train")[row].values.to_numpy(zero_copy_only=False).astype(bool)
                X = np.frombuffer(batch.column("x")[row].as_buffer(), float).reshape(-1, d)
                y = np.frombuffer(batch.column("y")[row].as_buffer(), float)
                for c in val_c if not flags.all() else ():
                    p = forward(state[c["trial_id"]][0], X[~flags], d, int(c["neurons"]), c["hiddenactivation"], c["activation"])[3]
                    end = sum(places[c["trial_id"]])
                    total[end + 3 : end + 5] += (float(loss_value(c["loss"], y[~flags], p).sum()), len(p))
                order = in_epoch_order(seed, epoch, batch.column("keys")[row].values) if train_c else np.empty(0, int)
                order = order[flags[order]]
                if len(order):
                    shards.append((X[order], y[order]))
            for c in train_c if shards else ():
                start, size = places[c["trial_id"]]
                for (_, y), (w, slots, t, loss) in zip(shards, train_shards(c, state[c["trial_id"]], shards, d), strict=True):
                    total[start : start + size] += len(y) * np.concatenate([w, *slots])
                    total[start + size : start + size + 3] += (len(y) * t, len(y), loss)
    return add


def validate_candidate(c: dict) -> str | None:
    known = {name: values for (est, _), space in DEFAULT_SPACES.items() if est == "mlp" for name, values in space.items()}
    if c.get("optimizer") not in known["optimizer"]:
        return f"unknown optimizer {c.get('optimizer')!r}"
    if c.get("hiddenactivation") not in known["hiddenactivation"] or c.get("activation") not in known["hiddenactivation"]:
        return "unknown activation"
    if not c.get("neurons") or int(c["neurons"]) < 1:
        return "neurons must be >= 1"
    if c.get("loss") not in ("binary_crossentropy", "mse"):
        return f"unknown loss {c.get('loss')!r}"
    return None


def fit_mlp(rows: DataFrame, cands: list[dict], n_features: int, seed: int = 0, epochs: int | None = None,
            patience: int | None = 20, n_shards: int | None = None):
    """Train every candidate; returns (final weights {trial: vec}, history rows, errors).

    ``rows``: ``(key, features, label, split)``. Rows are dealt to ``n_shards`` shards by a hash of their key
    (by default one for each ``SHARD_ROWS`` rows, so tasks grow with the rows); the shard count is part
    of the result's definition, cores and partitions are not. An epoch is ONE job: each shard is trained through
    from the same state, partitions add up their shards' parameters weighted by rows, and partial sums
    are summed in two levels. Early stopping on val loss with ``patience``; the weights of the last trained
    epoch are kept (Keras EarlyStopping default). History rows: ``(trial_id, epoch, train_loss, val_loss)``.
    """
    d = n_features
    errors = {c["trial_id"]: e for c in cands if (e := validate_candidate(c))}
    live = [c for c in cands if c["trial_id"] not in errors]
    if not live:
        return {}, [], errors
    state = {}
    for c in live:
        w = init_params(c["trial_id"], d, int(c["neurons"]), seed)
        state[c["trial_id"]] = (w, [np.zeros_like(w) for _ in range(n_slots(c["optimizer"]))], 0)
    if n_shards is None:
        n_shards = max(1, round(rows.filter(F.col("split").isin("train", "val")).count() / SHARD_ROWS))
    src = _packed_shards(rows, n_shards, d).persist(StorageLevel.MEMORY_AND_DISK)
    sc = rows.sparkSession.sparkContext
    places, size = _layout(live, d)
    max_ep = {c["trial_id"]: int(epochs if epochs is not None else c.get("epochs", 50)) for c in live}
    hist: dict = {}
    best = {c["trial_id"]: (math.inf, -1) for c in live}
    stopped: set = set()
    for e in range(max(max_ep.values(), default=0) + 1):
        train_c = [c for c in live if c["trial_id"] not in stopped and e < max_ep[c["trial_id"]]]
        val_c = [c for c in live if c["trial_id"] not in stopped and 1 <= e <= max_ep[c["trial_id"]]]
        if not train_c and not val_c:
            break
        shared = sc.broadcast((train_c, val_c, state))
        total = packed_sum(src, _train_shards(shared, d, seed, e, places), size)
        shared.unpersist()
        for c in val_c:
            tid = c["trial_id"]
            loss, n = total[sum(places[tid]) + 3 : sum(places[tid]) + 5]
            if not n:
                continue
            vl = loss / n
            hist.setdefault((tid, e - 1), [None, None])[1] = vl
            if vl < best[tid][0]:
                best[tid] = (vl, e - 1)
            elif patience is not None and (e - 1) - best[tid][1] >= patience:
                stopped.add(tid)
        for c in train_c:
            tid = c["trial_id"]
            at, own = places[tid]
            steps, n, loss = total[at + own : at + own + 3]
            if tid in stopped or not n:
                continue   # an epoch trained past the stop is discarded
            ps, ns = param_size(d, int(c["neurons"])), n_slots(c["optimizer"])
            vec = total[at : at + own] / n
            state[tid] = (vec[:ps], [vec[ps * (k + 1): ps * (k + 2)] for k in range(ns)], int(round(steps / n)))
            hist.setdefault((tid, e), [None, None])[0] = loss / n
    src.unpersist()
    hist_rows = [(tid, e, float(v[0]), None if v[1] is None else float(v[1])) for (tid, e), v in sorted(hist.items()) if v[0] is not None]
    return {tid: s[0] for tid, s in state.items()}, hist_rows, errors


def predict_scores(rows: DataFrame, weights: dict, cands: list[dict], n_features: int, split: str = "val") -> DataFrame:
    """``(trial_id, key, label, score)`` network outputs on ``split`` rows (vectorised per partition)."""
    d = n_features
    shared = rows.sparkSession.sparkContext.broadcast(({c["trial_id"]: c for c in cands if c["trial_id"] in weights}, weights))

    def run(batches):
        info, weights = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["features"].to_numpy()).astype(float)
            for tid, c in info.items():
                _, _, _, p = forward(weights[tid], X, d, int(c["neurons"]), c["hiddenactivation"], c["activation"])
                yield pd.DataFrame({"trial_id": tid, "key": pdf["key"].to_numpy(), "label": pdf["label"].to_numpy(dtype=float), "score": p})

    src = rows.filter(F.col("split") == split).select("key", "features", "label")
    return src.mapInPandas(run, "trial_id long, key string, label double, score double")
