import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tuneforge.llm import quality_forest as Q
from tuneforge.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")
MID = "/root/testdata/sf0.1"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_statistics_and_base_rule(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op3_quality_forest(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_held_out_labels(spark):
    """Fitted on the labels of even ids, judged on odd ones."""
    docs, labels = queries.table(spark, MID, "documents"), queries.table(spark, MID, "labels")
    verdicts = Q.quality_verdicts(docs, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1 and not base_failed")
    got = {(r["quality"], r["kept"]): r["count"] for r in verdicts.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert got.get((0, False), 0) / (got.get((0, False), 0) + got.get((0, True), 0)) > 0.9
    assert got.get((1, False), 0) / (got.get((1, False), 0) + got.get((1, True), 0)) < 0.01


def test_odd_rows(spark, odd_docs, make_docs):
    labels = queries.table(spark, SF_SMALL, "labels")
    rows = Q.quality_verdicts(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    texts = Counter(brute(r["text"]) for r in odd_docs.collect())
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == texts
    assert all(r["base_failed"] and not r["kept"] for r in rows if not r["n_words"])
    assert Q.quality_verdicts(make_docs([]), labels).collect() == []


@pytest.mark.parametrize("where", ["false", "quality = 1", "quality is null"])
def test_without_a_class_only_the_base_rule_rejects(spark, odd_docs, where):
    labels = queries.table(spark, SF_SMALL, "labels").where(where)
    assert all(r["kept"] != r["base_failed"] for r in Q.quality_verdicts(odd_docs, labels).collect())


def test_forest_scores_and_threshold():
    rng = np.random.default_rng(0)
    good, far = rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (20, 3))
    forest = Q.IsolationForest(50, 128, 1).fit(np.vstack([good, far[:5]]))
    scores = forest.score(np.vstack([good, far]))
    marks = np.arange(520) < 500
    cut = Q.calibrate(scores, marks, 0.01)
    assert (scores[marks] > cut).mean() <= 0.01 and (scores[~marks] > cut).all()
    same = np.ones((40, 3))
    assert np.allclose(Q.IsolationForest(5, 16).fit(same).score(same), 0.5)


def test_threshold_comes_from_all_labelled_rows(spark):
    """Beyond max_fit_rows Spark calibrates on every labelled row, as calibrate does."""
    stats = Q.written(Q.rule_statistics(queries.table(spark, "/root/testdata/sf0.01", "documents")))
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    forest, threshold = Q.fit(stats, labels, trees=20, subsample=16, max_good_rejected=0.05, max_fit_rows=10)
    rows = stats.where("n_words >= 20").join(labels, "doc_id").toPandas()
    assert len(rows) > 100
    want = Q.calibrate(forest.score(Q.features(rows[Q.COUNTS].to_numpy())), rows["quality"].to_numpy() > 0, 0.05)
    assert np.isfinite(want) and threshold == pytest.approx(want, abs=1e-12)
    assert Q.fit(stats, labels.where("quality = 1"), max_fit_rows=10) == (None, float("inf"))
