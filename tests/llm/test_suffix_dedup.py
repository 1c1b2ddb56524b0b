import hashlib

import numpy as np
import pytest

from tuneforge.llm import suffix_dedup as dedup


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by a dictionary of all 100-byte strings. Rows of one
    doc_id that differ are given in the operator's order."""
    out, seen = [], set()
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            string = data[at : at + 100]
            if string in seen:
                gone[at : at + 100] = True
            seen.add(string)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((doc_id, len(data), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 50_000, n))


def result(make_docs, rows):
    found = dedup.remove_repeats(make_docs(rows, clashes=True).repartition(4)).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2]))


def test_equals_brute_force(make_docs):
    rng = np.random.default_rng(4)
    line, passage = "All rights reserved by the makers of this very common line, which stands in many texts. ", words(rng, 60)
    base = [words(rng, int(n)) for n in rng.integers(0, 400, 40)]
    rows = []
    for i, text in enumerate(base):
        rows.append((3 * i, text))
        if i % 3 == 0:
            rows.append((3 * i + 1, text))  # an exact copy
        if i % 4 == 1 and len(text) > 300:
            cut = int(rng.integers(100, len(text) - 100))
            rows.append((3 * i + 2, text[:cut] + "é" + text[cut + 1 :]))  # a near copy
    rows += [(500 + k, words(rng, 30) + line * 2 + words(rng, 5 * k) + passage + words(rng, 20)) for k in range(12)]
    rows += [(700, "A" * 5000), (701, "ab" * 900 + "A" * 150), (702, ""), (703, None), (704, "x" * 99), (705, "x" * 100), (706, "x" * 101), (707, "日本語のテキスト" * 40), (708, "\n" * 250)]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    expected = brute(sorted(rows, key=lambda r: r[0]))
    assert sum(r[2] for r in expected) > 20_000
    assert result(make_docs, rows) == expected


def test_texts_longer_than_a_piece(make_docs):
    rng = np.random.default_rng(6)
    part = words(rng, 20_000)
    long = words(rng, 190_000)
    assert len(long) > dedup.PIECE
    rows = [(1, part[:5000] + long + part), (2, long[dedup.PIECE - 500 : dedup.PIECE + 700]), (3, long[3:])]
    assert result(make_docs, rows) == brute(rows)


def test_repeated_rows_and_null_ids(make_docs):
    rng = np.random.default_rng(8)
    a, b = words(rng, 40), words(rng, 50)
    rows = [(None, a), (5, a), (5, a), (6, b), (6, b), (6, b), (7, "short"), (7, "short")]
    assert result(make_docs, rows) == sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2]))


def test_empty_table(make_docs):
    assert result(make_docs, []) == []


@pytest.mark.parametrize("size", [99, 100, 101, 5000])
def test_phrases_cover_each_start_once(size):
    rng = np.random.default_rng(size)
    buf = rng.integers(97, 100, size).astype(np.uint8)
    trigger, first, n = dedup.parse(buf, np.array([size]))
    starts = [s for f, k in zip(first, n, strict=True) for s in range(f, f + k)]
    assert starts == list(range(size - 99 if size >= 100 else 0))
    assert all(f + k - 1 <= t < f + dedup.GAP and t + dedup.CORE <= size for t, f, k in zip(trigger, first, n, strict=True))
    # The trigger is a function of the start's own bytes.
    for t, f, k in zip(trigger, first, n, strict=True):
        for s in (f, f + k - 1):
            own, begin, _ = dedup.parse(buf[s : s + 100], np.array([100]))
            assert (own[0], begin[0]) == (t - s, 0)


def test_query_digest(spark):
    from tuneforge.llm import queries

    rows = queries.op12_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = sorted(queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect())
    expected = [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in brute([tuple(d) for d in docs])]
    assert sorted(tuple(r)[:5] for r in rows) == expected
