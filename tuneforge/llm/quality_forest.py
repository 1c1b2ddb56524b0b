"""Quality rules with an isolation forest on rule statistics.

One pass over whole texts gives each document its statistics. Each tree of the forest splits a
subsample, drawn from all labelled rows, at random values of random features (the method's own
``subsample``), and a document's score is 2 ** (-mean path length / expected length). The threshold is
calibrated on all labelled rows: of all cut points, the one with the highest balanced accuracy among those
that reject at most ``max_good_rejected`` of the rows labelled good. Up to ``max_fit_rows`` labelled
rows this is done on the driver; beyond, the subsamples alone are drawn to it (by a hash of the
row), and the rows are scored and the cut found by Spark. Statistics, scores and decisions cover all documents.

Definitions for odd rows: null and empty texts have no words, fail the base rule and are
rejected. Rows repeated under one doc_id are judged one by one. Where the labels hold no row of
either class, the method has no threshold and only the base rule rejects. A long text is read in
blocks. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneforge.llm import hashing as H
from tuneforge.llm.common import blocks, text_or_empty, written
from tuneforge.operators.scoring import roc_curve

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]
STATS_SCHEMA = "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)

#: Up to so many labelled rows are fitted and calibrated on the driver; beyond, Spark calibrates on all of them.
MAX_FIT_ROWS = 20_000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS = _table("#*$%&|<>")
_MARKS = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def repeated_words(hashes: np.ndarray, k: int) -> int:
    """Words in windows of k words that occur twice or more."""
    windows = H.window_hashes(hashes, k)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    hit[at] += 1
    np.subtract.at(hit, at + k, 1)
    return int((np.cumsum(hit) > 0).sum())


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def block_statistics(buf: np.ndarray, offsets: np.ndarray, k: int = 8) -> np.ndarray:
    """COUNTS of every row of a block of texts."""
    starts, ends, rows = H.word_spans(buf, offsets)
    hashes = H.word_hashes(buf, starts, ends, fold=False)
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(rows)
    out[:, 1] = _per_row(_POINT[buf] & ~H.SPACE[buf], offsets)
    out[:, 2] = _per_row(_SYMBOLS[buf], offsets)
    out[:, 6] = _per_row(_MARKS[buf], offsets)
    for i in range(len(offsets) - 1):
        own = hashes[rows[i] : rows[i + 1]]
        out[i, 5], out[i, 3] = duplicate_lines(buf[offsets[i] : offsets[i + 1]].tobytes())
        out[i, 4] = repeated_words(own, k)
    return out


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offsets in blocks(batch.column(2)):
            stats = block_statistics(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)] + [pa.array(stats[:, c]) for c in range(len(COUNTS))], names=["doc_id", "text_hash", *COUNTS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The counts of each document: one pass over whole texts, no shuffle."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(_statistics, STATS_SCHEMA)


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios that do not grow with a text's length: characters and symbols for each word, and the
    share of punctuation. (Repeats are left to the base rule: where they are few, clean texts have them too.)"""
    s = stats.astype(np.float64)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return np.column_stack([s[:, 1] / words, s[:, 2] / words, s[:, 6] / chars])


def expected_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(n, 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees over random splits, as flat arrays, so that whole blocks descend together."""

    def __init__(self, trees: int = 100, subsample: int = 256, seed: int = 7):
        self.trees, self.subsample, self.seed = trees, subsample, seed
        self.feature, self.cut, self.child, self.path = [], [], [], []

    def fit(self, x: np.ndarray, dealt: bool = False) -> IsolationForest:
        """``dealt``: the rows are the subsamples themselves, tree after tree in turn."""
        rng = np.random.default_rng(self.seed)
        size = min(self.subsample, len(x) // self.trees if dealt else len(x))
        limit = int(np.ceil(np.log2(max(size, 2)))) + 4
        for tree in range(self.trees):
            feature, cut, child, path = [], [], [], []

            def grow(own: np.ndarray, depth: int) -> int:
                node = len(feature)
                feature.append(-1), cut.append(0.0), child.append((node, node))
                path.append(depth + float(expected_path(float(len(own)))))
                low, high = own.min(0), own.max(0)
                usable = np.flatnonzero(high > low)
                if depth < limit and len(own) > 1 and len(usable):
                    f = int(rng.choice(usable))
                    at = float(rng.uniform(low[f], high[f]))
                    left = own[:, f] <= at
                    if not left.all():
                        feature[node], cut[node] = f, at
                        child[node] = (grow(own[left], depth + 1), grow(own[~left], depth + 1))
                return node

            grow(x[tree :: self.trees][:size] if dealt else x[rng.choice(len(x), size, replace=False)], 0)
            for mine, new in ((self.feature, feature), (self.cut, cut), (self.child, child), (self.path, path)):
                mine.append(np.array(new))
        self.scale = float(expected_path(float(size)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, path in zip(self.feature, self.cut, self.child, self.path):
            node = np.zeros(len(x), np.int64)
            open_rows = rows
            while len(open_rows):
                at = node[open_rows]
                open_rows, at = open_rows[feature[at] >= 0], at[feature[at] >= 0]
                right = x[open_rows, feature[at]] > cut[at]
                node[open_rows] = child[at, right.astype(np.int64)]
            total += path[node]
        return 2.0 ** (-total / max(len(self.feature), 1) / max(self.scale, 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, max_good_rejected: float) -> float:
    """The score above which a document is rejected; infinite if a class is missing."""
    if not good.any() or good.all():
        return float("inf")
    cuts = np.unique(scores)
    g, b = np.sort(scores[good]), np.sort(scores[~good])
    lost = 1 - np.searchsorted(g, cuts, side="right") / len(g)
    caught = 1 - np.searchsorted(b, cuts, side="right") / len(b)
    gain = np.where(lost <= max_good_rejected, caught - lost, -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= 0:
        return float("inf")
    above = cuts[k + 1] if k + 1 < len(cuts) else cuts[k]
    return float((cuts[k] + above) / 2)


def fit(stats: DataFrame, labels: DataFrame, trees: int = 100, subsample: int = 256, junk_share: float = 0.02, max_good_rejected: float = 0.005, max_fit_rows: int = MAX_FIT_ROWS, seed: int = 7) -> tuple[IsolationForest | None, float]:
    """Forest and threshold from labelled rows. Trees see ``junk_share`` of rows labelled bad."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = stats.where("doc_id is not null and n_words >= 20").join(marks, "doc_id").select("doc_id", "quality", *COUNTS)
    joined = written(joined)
    if joined.count() > max_fit_rows:
        return _fit_many(joined, trees, subsample, junk_share, max_good_rejected, seed)
    rows = joined.toPandas()
    if not len(rows):
        return None, float("inf")
    rows = rows.sort_values(["doc_id", *COUNTS])
    x, good = features(rows[COUNTS].to_numpy()), rows["quality"].to_numpy() > 0
    if not good.any() or good.all():
        return None, float("inf")
    rng = np.random.default_rng(seed)
    wanted = int(np.ceil(good.sum() * junk_share / (1 - junk_share)))
    bad = np.flatnonzero(~good)
    bad = rng.choice(bad, min(wanted, len(bad)), replace=False)
    forest = IsolationForest(trees, subsample, seed).fit(x[np.concatenate([np.flatnonzero(good), bad])])
    return forest, calibrate(forest.score(x), good, max_good_rejected)


def _fit_many(joined: DataFrame, trees: int, subsample: int, junk_share: float, max_good_rejected: float, seed: int) -> tuple[IsolationForest | None, float]:
    """Forest and threshold from labelled rows of any number: the driver gets the trees' subsamples alone."""
    def unit(k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "doc_id", *COUNTS), F.lit(1 << 40)) / F.lit(float(1 << 40))

    n = {r["good"]: r["count"] for r in joined.groupBy((F.col("quality") > 0).alias("good")).count().collect()}
    if len(n) < 2:
        return None, float("inf")
    bad_share = min(1.0, n[True] * junk_share / (1 - junk_share) / n[False])
    pool = joined.where((F.col("quality") > 0) | (unit(0) < bad_share))
    wanted = trees * subsample
    share = min(1.0, 1.2 * wanted / max(pool.count(), 1))  # leaves little more than the subsamples to be ordered
    drawn = pool.where(unit(1) < share).orderBy(unit(1), "doc_id", *COUNTS).limit(wanted).toPandas()
    forest = IsolationForest(trees, subsample, seed).fit(features(drawn[COUNTS].to_numpy()), dealt=len(drawn) >= 2 * trees)
    return forest, calibrate_all(scored(joined, forest, "doc_id long, quality int").selectExpr("0 AS one", "double(quality > 0) AS label", "score"), max_good_rejected)


def calibrate_all(rows: DataFrame, max_good_rejected: float) -> float:
    """``calibrate`` of rows (one, label, score) on Spark: ``one`` is constant, label 1 is good."""
    curve = roc_curve(rows, ["one"]).where((F.col("tpr") <= max_good_rejected) & (F.col("fpr") > F.col("tpr")))
    above = curve.agg(F.min_by("threshold", F.struct(F.col("tpr") - F.col("fpr"), "threshold"))).first()[0]
    if above is None:
        return float("inf")
    below = rows.where(F.col("score") < above).agg(F.max("score")).first()[0]
    return float((below + above) / 2)


def scored(stats: DataFrame, forest: IsolationForest, others: str) -> DataFrame:
    """``stats`` (the columns ``others`` and COUNTS) with the score of the forest."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.column_stack([batch.column(c).to_numpy() for c in COUNTS]).reshape(-1, len(COUNTS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(run, ", ".join([others, *(f"{c} long" for c in COUNTS), "score double"]))


def judge(stats: DataFrame, forest: IsolationForest | None, threshold: float) -> DataFrame:
    """Add base_failed, score and kept to each row of the statistics."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    if forest is None:
        return stats.withColumn("score", F.lit(None).cast("double")).withColumn("base_failed", failed).withColumn("kept", ~failed)
    found = scored(stats, forest, "doc_id long, text_hash long")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") <= F.lit(threshold)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, all statistics, score, base_failed and kept of every document."""
    stats = written(rule_statistics(docs))
    forest, threshold = fit(stats, labels, **options)
    return judge(stats, forest, threshold)
