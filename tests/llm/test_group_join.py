import random
import re

import numpy as np
import pytest

from tuneforge.llm import group_join as G
from tuneforge.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


def brute(rows):
    """(n_shingles, component_id) of each (doc_id, text); ids are distinct and not null."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def corpus(seed, n):
    """Chains of edits, copies, short texts and shared passages, so that many pairs are near the threshold."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(4))
    passage = [word() for _ in range(70)]
    texts = []
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.25 or not texts:
            texts.append(" ".join(word() for _ in range(rng.randrange(3, 120))))
        elif kind < 0.3:
            texts.append(rng.choice(texts))
        elif kind < 0.4:
            texts.append(" ".join(word() for _ in range(rng.randrange(0, 7))))
        elif kind < 0.55:
            own = [word() for _ in range(rng.randrange(5, 60))]
            texts.append(" ".join(own[:3] + passage + own[3:]))
        else:
            w = rng.choice(texts[-40:]).split()
            for _ in range(rng.randrange(1, 6)):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append("\n ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return list(enumerate(texts, 10))


def brute_rows(rows):
    """(doc_id, n_shingles, component_id) of rows whose ids may repeat or be null: each row is a set of its own."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got_rows(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=repr)


def test_a_leader_under_an_id_that_also_follows(make_docs):
    """Document 5 leads the group of A and repeats the text B of document 2: its link to 9 stays."""
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(2, b), (5, a), (5, b), (9, a + " more")]
    assert got_rows(G.near_duplicates(make_docs(rows))) == brute_rows(rows)
    assert (9, 57, 5) in brute_rows(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_repeated_and_null_ids_against_all_pairs(make_docs, seed):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.2 else rng.randrange(60), t) for _, t in corpus(seed, 200)]
    rows += rng.choices(rows, k=30)
    assert got_rows(G.near_duplicates(make_docs(rows))) == brute_rows(rows)


def test_near_copies_without_ids_go(make_docs):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(None, base), (None, base + " x"), (None, base + " y"), (3, "another text of its own that stays"), (None, "")]
    left = G.one_of_each(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in left) in [[(0, 0), (0, n), (3, 34)] for n in (len(base), len(base) + 2)]


@pytest.mark.parametrize("seed,hot_df", [(1, 16), (2, 2), (3, 10_000)])
def test_components_against_all_pairs(make_docs, seed, hot_df):
    rows = corpus(seed, 250)
    assert got(G.near_duplicates(make_docs(rows), hot_df=hot_df)) == brute(rows)


def test_a_large_group_of_near_copies_and_a_common_passage(make_docs):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        rows.append((d, " ".join(w)))
    rows += [(200 + d, " ".join(base[:60] + [f"own{d}x{k}" for k in range(90)])) for d in range(60)]
    rows += [(300 + d, " ".join(base)) for d in range(40)]
    assert got(G.near_duplicates(make_docs(rows))) == brute(rows)


def test_links_within_a_group_apart_from_its_leader(make_docs, monkeypatch):
    """Three classes under one prefix key: the second and third link, not with the first."""
    rows = [(1, " ".join(f"a{k}" for k in range(30))), (2, " ".join(f"b{k}" for k in range(30))), (3, " ".join(f"b{k}" for k in range(29)) + " z")]
    docs = make_docs(rows)
    sets = {d: len(shingles(t)) for d, t in rows}
    sigs = docs.sparkSession.createDataFrame([(d, 0, sets[d], c, 77, [5]) for d, c in zip((1, 2, 3), _classes(rows))], G.SIGNATURE)
    classes, found = G.link_classes(docs, sigs, 5, 75, 100)
    a = dict(zip((1, 2, 3), _classes(rows)))
    assert {r["node"]: r["component"] for r in found.collect()} == {a[2]: min(a[2], a[3]), a[3]: min(a[2], a[3])}


def _classes(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t.encode() for _, t in rows], pa.binary())], names=["doc_id", "text"])
    return next(G._classed_texts(5)([batch])).column(0).to_pylist()


def test_odd_rows(odd_docs, make_docs):
    rows = G.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(1, 4)}
    assert {c for _, c in by[5] | by[6]} == {5} and by[7] == {(1, 7)}
    assert {c for _, c in by[8]} == {8} and len(by[8]) == 2
    assert by[None] == {(0, None), (len(shingles("null id here " * 9)), None)}
    assert G.near_duplicates(make_docs([])).collect() == []


def test_one_of_each(odd_docs, make_docs):
    left = G.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(repr((r["doc_id"], (r["text"] or "")[:9])) for r in left.collect()) == sorted(
        repr(x) for x in [(1, ""), (2, ""), (3, " \n\t "), (4, "one two t"), (5, "w0x0 w1x1"), (7, "AAAAAAAAA"), (None, "null id h"), (None, ""), (8, "same text"), (8, "another t"), (9, "Ünïcödé À")])
    assert G.one_of_each(make_docs([])).collect() == []


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.75, 1))), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64)]))
        hot = np.sort((rng.choice(a, max(1, len(a) // 2)) >> np.uint64(32)).astype(np.uint32))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(G.prefix_of(a, hot, 75, 100), G.prefix_of(b, hot, 75, 100)))


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(f"p{k:03}", f"p{k + 1:03}") for k in range(64)] + [("s", f"s{k}") for k in range(300)] + [("x", "x")]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(found.values()) == {"p000", "s"} and len(found) == 65 + 301
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_numbers_are_gathered_as_bytes(spark):
    """What reaches the driver is a few values of bytes, whatever the session's Arrow setting."""
    df = spark.range(0, 50_000, 1, 7).selectExpr("25000 - id AS id")
    assert G.gathered(df, np.int64).tolist() == list(range(-24_999, 25_001))
    assert len(G.gathered(df.limit(0), np.int64)) == 0


def test_many_wanted_texts_are_joined_by_shuffle(make_docs, monkeypatch):
    rows = [(i, " ".join(f"w{i // 3}x{k}" for k in range(40)) + (" tail" if i % 3 else "")) for i in range(30)]
    few = got(G.near_duplicates(make_docs(rows)))
    monkeypatch.setattr(G, "MAX_IDS", 3)
    monkeypatch.setattr(G, "SMALL_ROWS", 3)
    assert got(G.near_duplicates(make_docs(rows))) == few == brute(rows)
