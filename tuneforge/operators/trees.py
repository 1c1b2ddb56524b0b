"""Batched histogram gradient boosting (the ``xgboost`` and ``gbdt`` estimators).

One candidate batch (K hyper-parameter sets) is boosted together. A pass over the rows evaluates a
set of tree nodes of all candidates in ONE job: each partition holds its gradient sums as one packed
array per candidate (a ``bincount`` over node x feature x bin), gives one row for each node that it
has met, and rows are summed by (candidate, parent). Only left children are counted; a right
child is its parent's histogram less its sibling's. The reducer of a parent finds the best split of
both children, and only splits (K x nodes rows) reach the driver. Trees go to the tasks as arrays, not as
literals of the plan, so a plan has the same size at every depth.

* ``xgboost``: level-wise, a pass for each level.
* ``gbdt``: best-first. Leaves wait in a queue by gain; the best one is split until the tree has
  ``max_leaves`` leaves. A pass evaluates the children of the best open leaves at once, as many as could
  still be split, so a tree takes about as many passes as it is deep; the queue is then played on the driver.

State is held in blocks of rows: the bins, labels, raw scores of all candidates and draws of a block's rows are
binary values of one row, so a pass reads arrays. Only training and validation rows are held. It is
persisted each round and written every ``checkpoint_every`` rounds, so lineage never grows with the number of
rounds and a lost executor replays at most that many rounds.

Deviations from the native libraries (declared): base score = mean-based (``boost_from_average``),
L2 = 1, min_child_weight = 1, no column sampling; ``subsample`` is applied to both estimators.
"""

from __future__ import annotations

import heapq
import math
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.functions.hashing import TWO_POW_32, md5_heads
from tuneforge.operators import scoring
from tuneforge.operators.packed import BLOCK_BYTES, packed_rows, packed_sum, unpacked
from tuneforge.session import cut_lineage, small_batches, spread_if_few

# objective names of both libraries -> loss family
OBJECTIVES = {
    "reg:linear": "squared", "reg:squarederror": "squared", "regression": "squared", "squared": "squared",
    "reg:tweedie": "tweedie", "tweedie": "tweedie",
    "reg:gamma": "gamma", "gamma": "gamma",
    "binary:logistic": "logistic", "binary": "logistic", "logistic": "logistic",
}


@dataclass
class BoostConfig:
    n_bins: int = 32
    binning: str = "quantile"          # 'quantile' (exact cuts) or 'uniform' (min/max)
    lambda_l2: float = 1.0
    min_child_weight: float = 1.0
    tweedie_power: float = 1.5
    seed: int = 0
    early_stopping_rounds: int | None = None
    checkpoint_every: int = 4       # reliable checkpoint cadence; rounds in between are persisted
    gain_decimals: int = 9
    verbose: bool = False
    record_history: bool = False    # validation cost every round (always on with early stopping)
    max_leaves: int | None = None   # a limit: best-first growth; None: level-wise


# ---------------------------------------------------------------- binning
@dataclass
class Binning:
    method: str
    n_bins: int
    cuts: list[list[float]] = field(default_factory=list)   # quantile cut points per feature
    lo: list[float] = field(default_factory=list)           # uniform: per-feature min
    hi: list[float] = field(default_factory=list)           # uniform: per-feature max

    def threshold(self, feature: int, b: int) -> float | None:
        """Raw-value threshold of 'bin <= b goes left'."""
        if self.method == "quantile":
            c = self.cuts[feature]
            return c[b] if b < len(c) else None
        lo, hi = self.lo[feature], self.hi[feature]
        return lo + (b + 1) * (hi - lo) / self.n_bins if hi > lo else None


#: Bits of a value that one pass of the quantile selection settles.
DIGIT = 11


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def exact_quantiles(rows: DataFrame, n_features: int, n_bins: int) -> list[list[float]]:
    """For each feature the value of rank ``ceil(n i / n_bins)``, i = 1 .. n_bins - 1, of its n values.

    Selection by range counts: a pass counts, for each value prefix that a wanted rank lies in, the next
    ``DIGIT`` bits of the values that have it. Six passes settle all 64 bits of all ranks; each gives one packed
    vector of counts whose size depends on features and bins alone. The values are written once, in blocks."""
    rows = packed_rows(rows, n_features)
    n = int(packed_sum(rows, lambda batch, total: np.add.at(total, 0, sum(len(x) for x, in unpacked(batch, n_features))), 1)[0])
    if n == 0:
        return [[] for _ in range(n_features)]
    # wanted: for each feature and rank the prefix found so far, and the rank among the values that have it
    wanted = [[[0, -(-n * i // n_bins)] for i in range(1, n_bins)] for _ in range(n_features)]
    done = 0
    while done < 64:
        width = min(DIGIT, 64 - done)
        prefixes = [np.array(sorted({p for p, _ in w}), np.uint64) for w in wanted]
        starts = np.cumsum([0, *(len(p) << width for p in prefixes)])
        rest = np.uint64(64 - done - width)

        def add(batch: pa.RecordBatch, total: np.ndarray, done=done, width=width, prefixes=prefixes, starts=starts, rest=rest) -> None:
            for x, in unpacked(batch, n_features):
                for j, known in enumerate(prefixes):
                    bits = _ordered_bits(x[:, j])
                    own = bits >> np.uint64(64 - done) if done else np.zeros(len(bits), np.uint64)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[at] == own
                    digit = (bits[hit] >> rest) & np.uint64((1 << width) - 1)
                    total[starts[j] : starts[j + 1]] += np.bincount((at[hit] << width) + digit.astype(np.int64), minlength=len(known) << width)

        counts = packed_sum(rows, add, int(starts[-1]))
        for j, known in enumerate(prefixes):
            below = np.cumsum(counts[starts[j] : starts[j + 1]].reshape(len(known), -1), axis=1)
            for w in wanted[j]:
                row = below[np.searchsorted(known, np.uint64(w[0]))]
                digit = int(np.searchsorted(row, w[1]))
                w[0], w[1] = (w[0] << width) | digit, w[1] - (int(row[digit - 1]) if digit else 0)
        done += width
    out = []
    for w in wanted:
        bits = np.array([p for p, _ in w], np.uint64)
        top = np.uint64(1 << 63)
        out.append(np.where(bits & top, bits ^ top, ~bits).view(np.float64).tolist())
    return out


def fit_binning(rows: DataFrame, n_features: int, n_bins: int, method: str = "quantile", fit_filter: Column | None = None) -> Binning:
    """Cut points from the training rows: F x n_bins numbers. Quantile cuts are exact."""
    src = rows if fit_filter is None else rows.filter(fit_filter)
    if method == "quantile":
        return Binning(method, n_bins, cuts=[sorted(set(q)) for q in exact_quantiles(src, n_features, n_bins)])
    if method == "uniform":
        aggs = []
        for j in range(n_features):
            x = F.element_at("features", j + 1)
            aggs += [F.min(x).alias(f"mn{j}"), F.max(x).alias(f"mx{j}")]
        row = src.agg(*aggs).first()
        return Binning(method, n_bins, lo=[row[f"mn{j}"] for j in range(n_features)], hi=[row[f"mx{j}"] for j in range(n_features)])
    raise ValueError(f"unknown binning {method!r}")


def uniform_bins(binning: Binning, n_features: int) -> Column:
    out = []
    for j in range(n_features):
        x = F.element_at("features", j + 1)
        lo, hi, B = binning.lo[j], binning.hi[j], binning.n_bins
        if hi is None or lo is None or hi <= lo:
            out.append(F.lit(0))
        else:
            raw = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(B)))
            out.append(F.greatest(F.lit(0), F.least(F.lit(B - 1), raw)).cast("int"))
    return F.array(*out)


def apply_binning(rows: DataFrame, binning: Binning, n_features: int) -> DataFrame:
    """``(key, bins ARRAY<INT>, label, split)``. Quantile bins: the number of cuts below a value, sought in
    vectors (an expression over the cuts would compute the value anew for each of them)."""
    if binning.method != "quantile":
        return rows.select("key", uniform_bins(binning, n_features).alias("bins"), "label", "split")
    cuts = [np.array(c, float) for c in binning.cuts]
    keep = ("key", "label", "split")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().fill_null(-np.inf).to_numpy(zero_copy_only=False).reshape(len(batch), n_features)
            bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * n_features, pa.int32()), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists, batch.column("label"), batch.column("split")], names=["key", "bins", "label", "split"])

    return rows.select("features", *keep).mapInArrow(run, f"key {fields['key']}, bins array<int>, label {fields['label']}, split {fields['split']}")


# ---------------------------------------------------------------- objectives
def gradients(kind: str, f: np.ndarray, y: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the loss at raw scores ``f``, per loss family."""
    if kind == "squared":
        return f - y, np.ones_like(f)
    if kind == "logistic":
        p = 1.0 / (1.0 + np.exp(-f))
        return p - y, np.maximum(p * (1.0 - p), 1e-16)
    if kind == "gamma":
        e = np.exp(-f)
        return 1.0 - y * e, y * e
    e1, e2 = np.exp((1.0 - rho) * f), np.exp((2.0 - rho) * f)
    return -y * e1 + e2, -y * (1.0 - rho) * e1 + (2.0 - rho) * e2


def transformed(kind: str, f: np.ndarray) -> np.ndarray:
    """Predictions of raw scores."""
    return f if kind == "squared" else 1.0 / (1.0 + np.exp(-f)) if kind == "logistic" else np.exp(f)


def base_score(kind: str, mean: float) -> float:
    if kind == "squared":
        return float(mean)
    if kind == "logistic":
        m = min(max(mean, 1e-6), 1 - 1e-6)
        return math.log(m / (1 - m))
    return math.log(mean)


# ---------------------------------------------------------------- booster
@dataclass
class BoostResult:
    costs: DataFrame          # (trial_id, cost, best_round, status, error)
    model: DataFrame          # (trial_id, round, level, node, feature, bin, threshold, leaf_value)
    history: DataFrame        # (trial_id, round, val_cost)
    cands: list[dict]
    binning: Binning | None = None


def _check_valid(stats, kind: str) -> str | None:
    mn, mx, mean, nonbin = stats["mn"], stats["mx"], stats["mean"], stats["nonbin"]
    if stats["n"] == 0:
        return "no training rows"
    if kind == "gamma" and not (mn > 0):
        return "gamma objective needs a strictly positive target"
    if kind == "tweedie" and not (mn >= 0 and mean > 0):
        return "tweedie objective needs a non-negative target with positive mean"
    if kind == "logistic" and nonbin > 0:
        return "logistic objective needs 0/1 labels"
    return None


class Tree:
    """A growing tree of one candidate. Nodes are numbered as in a heap: 1 is the root, 2n and 2n + 1 the
    children of n. ``stats``: what the passes found for each evaluated node."""

    def __init__(self, depth: int, max_leaves: int | None):
        self.depth, self.max_leaves, self.stats = depth, max_leaves, {}
        self.splits: list[int] = []

    def _splittable(self, node: int) -> bool:
        return node in self.stats and self.stats[node]["j"] is not None

    def _deeper(self, node: int) -> bool:
        """Whether children of a node may be split."""
        return node.bit_length() < self.depth

    def wanted(self) -> list[int]:
        """Parents whose children the next pass must evaluate (0: the root itself); none: it is grown."""
        if not self.stats:
            return [] if self.splits else [0]
        known = [n for n in self.stats if self._splittable(n)]
        if self.max_leaves is None:
            self.splits = known
            return [n for n in known if self._deeper(n) and 2 * n not in self.stats and 2 * n + 1 not in self.stats]
        self.splits, queue, leaves = [], [], 1
        if self._splittable(1):
            queue.append((-self.stats[1]["gain"], 1))
        while queue and leaves < self.max_leaves:
            _, node = heapq.heappop(queue)
            self.splits.append(node)
            leaves += 1
            if self._deeper(node):
                if 2 * node not in self.stats and 2 * node + 1 not in self.stats:
                    break  # its children must be known before the next leaf is chosen
                for child in (2 * node, 2 * node + 1):
                    if self._splittable(child):
                        heapq.heappush(queue, (-self.stats[child]["gain"], child))
        else:
            return []
        open_ = sorted((n for n in known if self._deeper(n) and 2 * n not in self.stats and 2 * n + 1 not in self.stats), key=lambda n: (-self.stats[n]["gain"], n))
        return open_[: self.max_leaves - 1]

    def arrays(self, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Feature (-1: none) and bin by node, for the given split nodes."""
        size = 2 * max([1, *nodes]) + 2
        feat, thr = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for n in nodes:
            feat[n], thr[n] = self.stats[n]["j"], self.stats[n]["b"]
        return feat, thr

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        return self.arrays([n for n in self.stats if self._splittable(n)])

    def leaves(self, lam: float, lr: float) -> dict[int, float]:
        out = {}
        for n in ([1] if 1 in self.stats else []) + [c for s in self.splits for c in (2 * s, 2 * s + 1)]:
            if n in self.splits:
                continue
            up = self.stats.get(n // 2)
            g, h = (up["gl"], up["hl"]) if n > 1 and n % 2 == 0 else (up["gr"], up["hr"]) if n > 1 else (self.stats[1]["gt"], self.stats[1]["ht"])
            out[n] = -g / (h + lam) * lr
        return out


def descend(bins: np.ndarray, feat: np.ndarray, thr: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        f = feat[node[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        if len(rows):
            at = node[rows]
            node[rows] = 2 * at + (bins[rows, f] > thr[at])
    return node


#: A block of rows of one split: matrices and vectors as bytes; raw scores candidate by candidate, none before the first
#: tree (all rows have the base score); keys and draws only if candidates draw rows.
_STATE = "split string, bins binary, label binary, f binary, keys array<string>, w binary"


def _array(batch: pa.RecordBatch, name: str, i: int, dtype, width: int | None = None) -> np.ndarray:
    """A binary value of a block as a vector, or as a matrix of ``width`` numbers a row."""
    v = np.frombuffer(batch.column(name)[i].as_buffer(), dtype)
    return v if width is None else v.reshape(-1, width)


def _raw(batch: pa.RecordBatch, i: int, bases: list[float]) -> np.ndarray:
    """[candidates, rows]: the raw scores of a block."""
    f, n = _array(batch, "f", i, float), len(_array(batch, "label", i, float))
    return f.reshape(len(bases), n) if len(f) else np.broadcast_to(np.array(bases)[:, None], (len(bases), n))


def _state(rows: list[tuple]) -> pa.RecordBatch:
    """Blocks (split, bins, label, f, keys, w) as a batch of the state."""
    split, bins, label, f, keys, w = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(split, pa.string()), *(pa.array([v.tobytes() for v in c], pa.binary()) for c in (bins, label, f)),
         pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.concat_arrays(keys)), pa.array([v.tobytes() for v in w], pa.binary())],
        names=["split", "bins", "label", "f", "keys", "w"])


def _draw(keys: pa.Array, split: str, draws: list[tuple[bytes, float]]) -> np.ndarray:
    """[rows, draws] of a training block: whether ``u(seed, trial_id, round, key) < subsample``, for each (prefix of the
    hashed text, subsample). Keyed by trial id, so a candidate gets the same bagging in any batch."""
    if not draws or split != "train":
        return np.empty((0, len(draws)), bool)
    heads = md5_heads(keys, [prefix for prefix, _ in draws])
    return np.ascontiguousarray((heads < np.array([[math.ceil(share * TWO_POW_32)] for _, share in draws], np.uint64)).T)


def _binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1] * m.itemsize), len(m), [None, pa.py_buffer(m)]).cast(pa.binary())


#: Bytes of histograms that a task holds before it gives them.
HELD = 256_000_000
_PARTIAL = "slot int, parent int, part int, hist binary"
_EVALUATED = "slot int, node int, hist binary, gt double, ht double, rows double, j int, b int, gain double, gl double, hl double, gr double, hr double"


def _partials(trees: dict[int, tuple], kinds: dict[int, str], n_features: int, n_bins: int, bases: list[float], n_draws: int, rho: float, dtype):
    """Histograms (gradient, hessian, rows) of the wanted left children, or roots, of one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), {}, n_features * n_bins

        def give() -> Iterator[pa.RecordBatch]:
            for slot, total in held.items():
                parents = trees[slot][3]
                met = np.flatnonzero(total[:, :, 2].any(axis=1))
                if len(met):
                    n = len(met)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, slot, np.int32)), pa.array(parents[met].astype(np.int32)), pa.array(np.full(n, part, np.int32)), _binary(total[met].reshape(n, -1))], names=["slot", "parent", "part", "hist"])
            held.clear()

        def count(bins: np.ndarray, f: np.ndarray, y: np.ndarray, drawn: np.ndarray) -> None:
            places = bins + np.arange(n_features) * n_bins
            for slot, (feat, thr, place, parents, draw) in trees.items():
                at = place[np.minimum(descend(bins, feat, thr), len(place) - 1)]
                rows = np.flatnonzero((at >= 0) & drawn[:, draw] if draw is not None else at >= 0)
                if not len(rows):
                    continue
                g, h = gradients(kinds[slot], f[slot][rows], y[rows], rho)
                if slot not in held:
                    held[slot] = np.zeros((len(parents), size, 3))
                flat = ((at[rows] * size)[:, None] + places[rows]).ravel()
                total = held[slot].reshape(-1, 3)
                n = np.bincount(flat, minlength=len(total))
                total[:, 0] += np.bincount(flat, np.repeat(g, n_features), minlength=len(total))
                total[:, 1] += n if kinds[slot] == "squared" else np.bincount(flat, np.repeat(h, n_features), minlength=len(total))
                total[:, 2] += n

        for batch in batches:
            for i in range(len(batch)):
                count(_array(batch, "bins", i, dtype, n_features), _raw(batch, i, bases), _array(batch, "label", i, float), _array(batch, "w", i, bool, n_draws) if n_draws else None)
                if sum(t.nbytes for t in held.values()) > HELD:
                    yield from give()
        yield from give()
    return run


def best_split(hist: np.ndarray, cfg: BoostConfig) -> dict:
    """Totals and best split of a histogram [features, bins, 3]; ties go to the least feature, then bin."""
    left = np.cumsum(hist, axis=1)
    gl, hl = left[:, :, 0], left[:, :, 1]
    gt, ht = gl[:, -1:], hl[:, -1:]
    gr, hr = gt - gl, ht - hl
    lam = cfg.lambda_l2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.round(gl * gl / (hl + lam) + gr * gr / (hr + lam) - gt * gt / (ht + lam), cfg.gain_decimals)
    ok = (hl >= cfg.min_child_weight) & (hr >= cfg.min_child_weight) & (gain > 0)
    out = {"gt": gt[0, 0], "ht": ht[0, 0], "rows": left[0, -1, 2]} | dict.fromkeys(("j", "b", "gain", "gl", "hl", "gr", "hr"))
    if ok.any():
        j, b = np.unravel_index(np.argmax(np.where(ok, gain, -np.inf)), gain.shape)
        out |= {"j": int(j), "b": int(b), "gain": gain[j, b], "gl": gl[j, b], "hl": hl[j, b], "gr": gr[j, b], "hr": hr[j, b]}
    return out


def _hists(table: pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(h.as_buffer(), np.float64) for h in table.column("hist")])


def _summed(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    return table.slice(0, 1).set_column(3, "hist", pa.array([_hists(table).sum(axis=0).tobytes()], pa.binary()))


def _evaluate(n_features: int, n_bins: int, cfg: BoostConfig):
    """Sum the partial histograms of a parent's left child, take the right one as the rest, and find
    the best split of both. The parent's own histogram has part -1."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_EVALUATED))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        slot, parent, parts = table.column("slot")[0].as_py(), table.column("parent")[0].as_py(), table.column("part").to_numpy()
        hists = _hists(table)
        left = hists[parts >= 0].sum(axis=0).reshape(n_features, n_bins, 3)
        nodes = {1: left}
        if parent:
            right = hists[0].reshape(left.shape) - left
            right[right[:, :, 2] <= 0] = 0.0  # bins without rows hold nothing
            nodes = {2 * parent: left, 2 * parent + 1: right}
        rows = [{"slot": slot, "node": n, "hist": h.tobytes()} | best_split(h, cfg) for n, h in nodes.items() if h[0, :, 2].any()]
        return pa.Table.from_pylist(rows, schema=schema)
    return run


def evaluate_nodes(spark: SparkSession, train: DataFrame, wanted: dict[int, list[int]], trees: dict[int, Tree], draws: dict[int, int | None], kinds: dict[int, str],
                   hists: list[DataFrame], n_features: int, n_bins: int, bases: list[float], cfg: BoostConfig, dtype, n_parts: int) -> DataFrame:
    """One job: ``_EVALUATED`` rows of the children of the wanted parents (or of roots) of all candidates."""
    sent = {}
    for slot, parents in wanted.items():
        feat, thr = trees[slot].known()
        targets = np.array([2 * p if p else 1 for p in parents])
        place = np.full(int(targets.max()) + 2, -1, np.int64)
        place[targets] = np.arange(len(targets))
        sent[slot] = feat, thr, place, np.array(parents), draws[slot]
    n_draws = sum(d is not None for d in draws.values())
    parts = train.mapInArrow(_partials(sent, kinds, n_features, n_bins, bases, n_draws, cfg.tweedie_power, dtype), _PARTIAL)
    if n_parts > 64:
        parts = parts.groupBy("slot", "parent", F.floor(F.col("part") / 64).alias("run")).applyInArrow(_summed, _PARTIAL)
    pairs = [(s, p) for s, ps in wanted.items() for p in ps if p]
    if pairs:
        # the wanted parents are known by number: as many rows as nodes of the batch's trees
        asked = F.broadcast(spark.createDataFrame(pairs, "slot int, node int"))
        for h in hists:
            own = h.join(asked, ["slot", "node"], "left_semi")
            parts = parts.unionByName(own.select("slot", F.col("node").alias("parent"), F.lit(-1).alias("part"), "hist"))
    return parts.groupBy("slot", "parent").applyInArrow(_evaluate(n_features, n_bins, cfg), _EVALUATED)


def _first_state(n_slots: int, n_features: int, dtype, draws: list[tuple[bytes, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * n_slots + n_features * np.dtype(dtype).itemsize + 8))
        for batch in batches:
            for at in range(0, len(batch), step):
                some, rows = batch.slice(at, step), []
                for split in ("train", "val"):
                    own = some.filter(pc.equal(some.column("split"), split))
                    if len(own):
                        bins = own.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(own), n_features).astype(dtype)
                        keys = own.column("keys") if draws else pa.array([], pa.string())
                        rows.append((split, bins, own.column("label").to_numpy(zero_copy_only=False), np.empty(0), keys, _draw(keys, split, draws)))
                if rows:
                    yield _state(rows)
    return run


def _next_state(grown: dict[int, tuple], n_features: int, bases: list[float], dtype, draws: list[tuple[bytes, float]]):
    """Add the leaf of each grown tree to the raw scores, and draw the rows of the next round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                bins, f = _array(batch, "bins", i, dtype, n_features), _raw(batch, i, bases).copy()
                for slot, (feat, thr, leaf) in grown.items():
                    f[slot] += leaf[descend(bins, feat, thr)]
                split, keys = batch.column("split")[i].as_py(), batch.column("keys")[i].values
                yield _state([(split, bins, _array(batch, "label", i, float), f, keys, _draw(keys, split, draws))])
    return run


def fit_boosted_trees(
    spark: SparkSession,
    binned: DataFrame,
    cands: list[dict],
    score: str,
    config: BoostConfig | None = None,
    binning: Binning | None = None,
) -> BoostResult:
    """Boost every candidate of ``cands`` at once.

    ``binned``: ``(key, bins ARRAY<INT>, label, split)`` with split in train/val/(test).
    ``cands``: dicts with ``trial_id, objective, learning_rate, max_depth, n_estimators, subsample``.
    """
    with small_batches(spark):
        return _boosted(spark, binned, cands, score, config or BoostConfig(), binning)


def _boosted(spark: SparkSession, binned: DataFrame, cands: list[dict], score: str, cfg: BoostConfig, binning: Binning | None) -> BoostResult:
    K = len(cands)
    cands = [dict(c) for c in cands]
    for c in cands:
        c["kind"] = OBJECTIVES.get(str(c.get("objective")), None)
    st = binned.filter(F.col("split") == "train").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("mn"), F.max("label").alias("mx"), F.avg("label").alias("mean"),
        F.sum(F.when(~F.col("label").isin(0.0, 1.0), 1).otherwise(0)).alias("nonbin"),
        F.max(F.size("bins")).alias("n_features"), F.max(F.array_max("bins")).alias("last_bin"),
    ).first().asDict()
    errors = {}
    for c in cands:
        if c["kind"] is None:
            errors[c["trial_id"]] = f"unknown objective {c.get('objective')!r}"
        else:
            e = _check_valid(st, c["kind"])
            if e:
                errors[c["trial_id"]] = e
        d, t, s, lr = c.get("max_depth"), c.get("n_estimators"), c.get("subsample"), c.get("learning_rate")
        if c["trial_id"] not in errors and not (d is not None and d >= 1 and t is not None and t >= 0 and s is not None and 0 < s <= 1 and lr is not None):
            errors[c["trial_id"]] = "invalid max_depth (>= 1) / n_estimators / subsample / learning_rate"
    for c in cands:
        c["ok"] = c["trial_id"] not in errors
        c["base"] = base_score(c["kind"], st["mean"]) if c["ok"] else 0.0

    n_features, n_bins = st["n_features"] or 0, (st["last_bin"] or 0) + 1
    dtype = np.uint8 if max(cfg.n_bins, n_bins) <= 256 else np.uint16
    drawing = [i for i, c in enumerate(cands) if c["ok"] and float(c["subsample"]) < 1.0]
    draws: dict[int, int | None] = {i: drawing.index(i) if i in drawing else None for i in range(K)}
    kinds = {i: c["kind"] for i, c in enumerate(cands) if c["ok"]}
    T = max([int(c["n_estimators"]) for c in cands if c["ok"]] or [0])

    def drawn(r: int) -> list[tuple[bytes, float]]:
        """Draws of round r are made once, not once per pass."""
        return [(f"{cfg.seed}:{cands[i]['trial_id']}:{r}".encode(), float(cands[i]["subsample"])) for i in drawing]

    state = n_parts = None
    bases = [float(c["base"]) for c in cands]
    if T:
        own_key = F.coalesce(F.concat(F.lit(":"), F.col("key").cast("string")), F.lit("")) if drawing else F.lit("")
        first = spread_if_few(binned).select("bins", F.col("label").cast("double").alias("label"), "split", own_key.alias("keys"))
        state = cut_lineage(first.mapInArrow(_first_state(K, n_features, dtype, drawn(0)), _STATE), blocks=True)
        n_parts = state.rdd.getNumPartitions()

    model_rows: list[tuple] = []
    history_rows: list[tuple] = []
    best = {c["trial_id"]: (None, -1) for c in cands}     # trial -> (best cost, best round)
    last_cost = {c["trial_id"]: None for c in cands}
    stopped: set = set()
    state_persisted = None

    for r in range(T):
        active = [i for i, c in enumerate(cands) if c["ok"] and r < int(c["n_estimators"]) and c["trial_id"] not in stopped]
        if not active:
            break
        trees = {i: Tree(int(cands[i]["max_depth"]), cfg.max_leaves) for i in active}
        train, hists = state.filter(F.col("split") == "train"), []
        wanted = {i: [0] for i in active}
        while wanted:
            _t = time.time()
            found = evaluate_nodes(spark, train, wanted, trees, draws, kinds, hists, n_features, n_bins, bases, cfg, dtype, n_parts).persist(StorageLevel.MEMORY_AND_DISK)
            for row in found.drop("hist").collect():   # bounded: the children of the wanted parents
                trees[row["slot"]].stats[row["node"]] = row.asDict()
            hists.append(found)
            if cfg.verbose:
                print(f"[boost] round {r}, {sum(map(len, wanted.values()))} parents of {len(wanted)} trees: {time.time() - _t:.2f}s", file=sys.stderr)
            wanted = {i: w for i in wanted if (w := trees[i].wanted()) and trees[i].stats}
        for h in hists:
            h.unpersist()
        grown = {}
        for i, tree in trees.items():
            tid, d = cands[i]["trial_id"], tree.depth
            leaves = tree.leaves(cfg.lambda_l2, float(cands[i]["learning_rate"]))
            if not leaves:
                continue
            feat, thr = tree.arrays(tree.splits)
            leaf = np.zeros(len(feat))
            for n in tree.splits:
                level = n.bit_length() - 1
                j, b = tree.stats[n]["j"], tree.stats[n]["b"]
                model_rows.append((tid, r, level, n - (1 << level), j, b, binning.threshold(j, b) if binning else None, None))
            for n, value in leaves.items():  # named by the place it would have if its rows went left to the full depth
                level = n.bit_length() - 1
                leaf[n] = value
                model_rows.append((tid, r, d, (n - (1 << level)) << (d - level), None, None, None, float(value)))
            grown[i] = feat, thr, leaf
        _t = time.time()
        prev = state_persisted
        last = r == T - 1  # what is left to do is the cost of validation rows
        state = state.filter(F.col("split") == "val") if last else state
        state = state.mapInArrow(_next_state(grown, n_features, bases, dtype, [] if last else drawn(r + 1)), _STATE)
        if (r + 1) % cfg.checkpoint_every == 0 and not last:
            state = cut_lineage(state, blocks=True)     # lineage cut: a lost executor replays < cadence rounds
            state_persisted = None
        else:
            state = state.persist(StorageLevel.DISK_ONLY)   # larger than the memory of any cluster that it is worth it for
            state_persisted = state
        # validation cost of this round for the active candidates
        every_round = cfg.record_history or cfg.early_stopping_rounds is not None
        act_cands = [dict(cands[i], slot=i) for i in active if every_round or int(cands[i]["n_estimators"]) == r + 1]
        vc = _val_costs_slots(state, act_cands, score, bases) if act_cands else {}
        if state_persisted is not None and not act_cands:
            state.select("f").write.format("noop").mode("overwrite").save()  # held before its predecessor is let go
        if prev is not None:
            prev.unpersist()
        if cfg.verbose:
            print(f"[boost] round {r} update and val cost: {time.time() - _t:.2f}s", file=sys.stderr)
        for i in active:
            tid = cands[i]["trial_id"]
            if tid not in vc and not every_round:
                continue
            cost = vc.get(tid)
            last_cost[tid] = cost
            history_rows.append((tid, r, cost))
            bc, br = best[tid]
            if cost is not None and not math.isnan(cost) and (bc is None or round(cost, cfg.gain_decimals) < round(bc, cfg.gain_decimals)):
                best[tid] = (cost, r)
            elif cfg.early_stopping_rounds is not None and r - best[tid][1] >= cfg.early_stopping_rounds:
                stopped.add(tid)
    if state_persisted is not None:
        state_persisted.unpersist()

    cost_rows = []
    for c in cands:
        tid = c["trial_id"]
        if not c["ok"]:
            cost_rows.append((tid, None, None, "failed", errors[tid]))
            continue
        if int(c["n_estimators"]) == 0:
            cost_rows.append((tid, None, None, "failed", "n_estimators = 0"))
            continue
        if cfg.early_stopping_rounds is not None:
            cost, rnd = best[tid]
        else:
            cost, rnd = last_cost[tid], int(c["n_estimators"]) - 1
        bad = cost is None or math.isnan(cost) or math.isinf(cost)
        cost_rows.append((tid, None if bad else float(cost), rnd, "failed" if bad else "ok", "non-finite cost" if bad else None))
    costs = spark.createDataFrame(cost_rows, "trial_id bigint, cost double, best_round int, status string, error string")
    if cfg.early_stopping_rounds is not None:   # the model ends with the round whose cost is reported
        model_rows = [m for m in model_rows if m[1] <= best[m[0]][1]]
    model = spark.createDataFrame(model_rows, "trial_id bigint, round int, level int, node bigint, feature int, bin int, threshold double, leaf_value double")
    history = spark.createDataFrame(history_rows, "trial_id bigint, round int, val_cost double")
    return BoostResult(costs, model, history, cands, binning)


def _val_costs_slots(state: DataFrame, act: list[dict], score: str, bases: list[float]) -> dict[int, float]:
    """``{trial_id: cost}`` on the validation rows; RMSE and accuracy are summed in the pass, for the AUC a block gives
    its distinct scores. Without rows there are no costs."""
    if score not in ("rmse", "acc", "auc"):
        raise ValueError(f"unknown score {score!r}")

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
        for i in range(len(batch)):
            f, y = _raw(batch, i, bases), _array(batch, "label", i, float)
            for k, c in enumerate(act):
                yield k, c, y, transformed(c["kind"], f[c["slot"]])

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for k, _, y, p in scored(batch):
            hit = (y - p) ** 2 if score == "rmse" else y == ~(p <= 0.5)
            total[k] += hit.sum()
            total[-1] += len(y) if k == 0 else 0

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c, y, p in scored(batch):
                for label in (0.0, 1.0):
                    values, counts = np.unique(p[(y == 1) == bool(label)], return_counts=True)
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c["trial_id"], np.int64)), pa.array(np.full(n, label)), pa.array(values), pa.array(counts.astype(np.int64))], names=["trial_id", "label", "score", "n_rows"])

    val = state.filter(F.col("split") == "val").select("label", "f")
    if score == "auc":
        x = val.mapInArrow(distinct, "trial_id bigint, label double, score double, n_rows bigint")
        return {r["trial_id"]: r["cost"] for r in scoring.auc_cost(x, ["trial_id"]).collect()}
    *sums, n = packed_sum(val, add, len(act) + 1)
    return {c["trial_id"]: math.sqrt(s / n) if score == "rmse" else float(1.0 - s / n) for c, s in zip(act, sums, strict=True)} if n else {}


# ---------------------------------------------------------------- prediction
@dataclass
class Forest:
    """All trees of a batch as node arrays: feature (-1: a leaf), bin, left child (the right one follows),
    leaf value; trees by candidate in the order of rounds."""

    feat: np.ndarray
    thr: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: dict[int, list[int]]

    @staticmethod
    def of(rows: list) -> Forest:
        """From rows of a model table."""
        trees: dict[tuple, list] = {}
        for r in rows:
            trees.setdefault((r["trial_id"], r["round"]), []).append(r)
        feat, thr, left, value, roots = [], [], [], [], {}
        for (trial, _), own in sorted(trees.items()):
            splits = {(r["level"], r["node"]): r for r in own if r["leaf_value"] is None}
            leaves = {r["node"]: r["leaf_value"] for r in own if r["leaf_value"] is not None}
            depth = max(r["level"] for r in own if r["leaf_value"] is not None)
            roots.setdefault(trial, []).append(len(feat))
            todo = [(0, 0)]
            first = len(feat)
            for at, (level, node) in enumerate(todo):  # grows while it is walked: children lie side by side
                split = splits.get((level, node))
                feat.append(split["feature"] if split else -1)
                thr.append(split["bin"] if split else 0)
                left.append(first + len(todo) if split else first + at)
                value.append(0.0 if split else leaves.get(node << (depth - level), 0.0))
                if split:
                    todo += [(level + 1, 2 * node), (level + 1, 2 * node + 1)]
        return Forest(np.array(feat, np.int32), np.array(thr, np.int32), np.array(left, np.int64), np.array(value), roots)

    def raw(self, bins: np.ndarray, trial: int, base: float) -> np.ndarray:
        out = np.full(len(bins), base)
        for root in self.roots.get(trial, []):
            node, rows = np.full(len(bins), root), np.arange(len(bins))
            while len(rows):
                f = self.feat[node[rows]]
                rows, f = rows[f >= 0], f[f >= 0]
                if len(rows):
                    at = node[rows]
                    node[rows] = self.left[at] + (bins[rows, f] > self.thr[at])
            out += self.value[node]
        return out


def predict_boosted(binned: DataFrame, model: DataFrame, cands: list[dict], keep=("key", "label", "split")) -> DataFrame:
    """Apply fitted boosters (the ``model`` table) to binned rows: ``(trial_id, *keep, raw, score)``.

    The model (candidates x rounds x nodes rows) goes to the tasks once, as node arrays that are
    walked in vectors over Arrow batches; the plan is the same for any forest.
    """
    forest = Forest.of(model.collect())   # the model table: bounded by the batch
    wanted = [(c["trial_id"], float(c.get("base", 0.0)), c["kind"]) for c in cands]
    fields = {f.name: f.dataType.simpleString() for f in binned.schema}
    shared = binned.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for trial, base, kind in wanted:
                raw = shared.value.raw(bins, trial, base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), trial, np.int64)), *(batch.column(c) for c in keep), pa.array(raw), pa.array(transformed(kind, raw))], names=["trial_id", *keep, "raw", "score"])

    return binned.select(*keep, "bins").mapInArrow(run, "trial_id bigint, " + ", ".join(f"{c} {fields[c]}" for c in keep) + ", raw double, score double")
