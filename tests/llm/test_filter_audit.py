import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tuneforge.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(docs, labels):
    """Filters applied one after another to lists of rows, for each part and order."""
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        early = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        marks = [(q, x) for i, q, x in labels if doc_id is not None and i == doc_id]
        rows.append((source or "", dict(zip("ABCDE", [*fails(text), early], strict=True)), any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left, before = [r for r in left if r[1][f]], [r for r in left if not r[1][f]], left
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in own) - sum(r[1][f] for r in before),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def result(spark, docs, labels):
    table = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows = filter_audit.audit(table.selectExpr("*", "1 AS mask", "2 AS part", "3 AS n"), spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_filters_applied_one_by_one(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "short text", "A B # c", " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " # X", " ".join("aa bb cc".split() * 90),
             " ".join(f"W{k}é" for k in range(220)), "x" * 200_000, "　   word"]
    docs = [(int(rng.integers(0, 40)), texts[rng.integers(0, len(texts))], [None, "", "s1", "s2"][rng.integers(0, 4)]) for _ in range(90)]
    docs += [(None, "short text", "s1"), (None, "short text", "s1"), (3, "short text", "s1"), (3, "short text", "s1")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 40, 25)] + [(None, 1, 1), (5, None, None)]
    expected = brute(docs, labels)
    found = result(spark, docs, labels)
    assert found == expected
    assert {k[0] for k in found} == {"", "s1", "s2"}


def test_empty_table(spark):
    assert result(spark, [], [(1, 1, 1)]) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_equals_sums_over_masks(seed):
    counts = np.random.default_rng(seed).integers(0, 50, (4, 32, 3))
    states = filter_audit.gray_walk(counts)
    for subset in range(32):
        plain = sum(counts[:, m] for m in range(32) if m & subset == 0)
        assert (states[:, subset] == plain).all()
