import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tests.conftest import SF_SMALL
from tuneforge.llm import pseudo_likelihood as P
from tuneforge.llm import queries


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in P.initial_params(5, 4, 1).items()}
    classes = rng.integers(0, 5, 40)
    around = P.windows(classes, 5)
    loss = lambda: -P.forward(p, around)[1][np.arange(40), classes].mean()
    for name, g in P.gradients(p, around, classes).items():
        for at in [tuple(rng.integers(0, n) for n in p[name].shape) for _ in range(6)]:
            keep = p[name][at]
            p[name][at] = keep + 1e-5
            up = loss()
            p[name][at] = keep - 1e-5
            down = loss()
            p[name][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_windows_see_both_sides_and_not_the_token():
    w = P.windows(np.array([1, 2, 3, 4]), 9)
    assert w.T.tolist() == [[9, 9, 2, 3], [9, 1, 3, 4], [1, 2, 4, 9], [2, 3, 9, 9]]


def test_class_probabilities_sum_to_one():
    counts = np.array([50, 30, 9, 4, 2, 1, 7])
    m = P.make_model({b"w%d" % k: k for k in range(6)}, counts, 4, 3, 0)
    total = np.zeros(4)
    np.add.at(total, m.classes, np.exp(m.within))
    assert np.allclose(total[np.unique(m.classes)], 1) and m.classes[-1] == 3


def test_scores_do_not_depend_on_partitions_and_training_helps(spark, make_docs):
    rng = np.random.default_rng(2)
    texts = [" ".join(("one two three four five " * 12).split()[: int(rng.integers(5, 60))]) for _ in range(200)]
    docs = make_docs(list(enumerate(texts)))
    args = dict(vocabulary=8, n_classes=6, hidden=8, shard_tokens=3000, batch_size=64)
    run = lambda d, **more: {r["doc_id"]: r["log_prob"] for r in P.score_documents(d, **args, **more).collect()}
    a, b = run(docs.coalesce(1)), run(docs.repartition(5, "text"))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * abs(a[k]) + 1e-9 for k in a)
    assert sum(run(docs, rounds=4).values()) > 0.6 * sum(run(docs, rounds=0).values())
    assert sum(run(docs, rounds=4).values()) > sum(a.values())


def test_blocks_and_whole_texts(spark):
    index = {b"a": 0, b"b": 1, b"c": 2}
    m = P.make_model(index, np.array([5, 3, 2, 1]), 3, 4, 0)
    tokens = np.random.default_rng(0).integers(0, 4, 1000)
    assert np.isclose(P.document_log_prob(m, tokens, 7), P.document_log_prob(m, tokens, 5000))


def test_word_order_matters_to_held_out_texts(spark):
    """A model trained on half of the documents scores unseen texts above the same words in random order."""
    docs = queries.table(spark, SF_SMALL, "documents")
    seen, unseen = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index, counts, total, _ = P.build_vocabulary(seen, 2000)
    model = P.make_model(index, counts, 32, 16, 3)
    tokens = P.tokenise(seen, spark.sparkContext.broadcast(model))
    model = P.train(tokens, model, total, 20_000, 3, 128, 0.5, 0.1)
    rng, wins, texts = np.random.default_rng(1), 0, 0
    for r in unseen.collect():
        tokens, _ = model.tokens((r["text"] or "").encode())
        if len(tokens) >= 30:
            texts += 1
            wins += P.document_log_prob(model, tokens) > np.mean([P.document_log_prob(model, rng.permutation(tokens)) for _ in range(3)])
    assert texts > 50 and wins > 0.6 * texts


def test_document_score_by_explicit_products(spark, make_docs):
    """The query's score of a text from the definition: for each word, the network's class probability
    times every decision on the way to the word, times its share of the bucket."""
    docs = make_docs([(1, "a b rare a c b"), (2, "a a b c rare"), (3, "b c a")])
    args = dict(vocabulary=3, n_classes=3, hidden=4, rounds=0, seed=3)
    score = {r["doc_id"]: r["log_prob"] for r in P.score_documents(docs, **args).collect()}
    index, counts, _, _ = P.build_vocabulary(docs, 3)
    model = P.make_model(index, counts, 3, 4, 3)
    p, words, edge = model.params, "a b rare a c b".split(), len(model.classes)
    tokens = [index.get(w.encode(), 3) for w in words]
    total = 0.0
    for i, t in enumerate(tokens):
        h = p["b"].astype(float)
        for s, side in enumerate(P.SIDES):
            at = tokens[i + side] if 0 <= i + side < len(tokens) else edge
            h = h + p["e"][at].astype(float) * p["a"][s]
        h = np.maximum(h, 0)
        z = np.exp(h @ p["w"] + p["c"])
        prob = z[model.classes[t]] / z.sum()
        for k in range(model.paths.begin[t], model.paths.begin[t + 1]):
            node, sign = model.paths.nodes[k], model.paths.signs[k]
            prob *= 1 / (1 + np.exp(-sign * (p["u"][node, :-1] @ h + p["u"][node, -1])))
        total += np.log(prob) + (np.log(2 / 2) if t == 3 else 0)  # "rare" is all of its bucket
    assert np.isclose(score[1], total, rtol=1e-5)


def test_row_sums_of_large_numbers():
    rows = np.random.default_rng(0).integers(0, 1 << 20, 5000) // 7 * 3
    at, sums, n = P._row_sums(rows, np.ones((5000, 2)))
    want, count = np.unique(rows, return_counts=True)
    assert (at == want).all() and (n == count).all() and (sums == count[:, None]).all()


def test_odd_rows(odd_docs, make_docs):
    rows = P.score_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((r["text"] or "").split()) for r in odd_docs.collect())
    assert all(r["log_prob"] == 0 and r["mean_log_prob"] is None for r in rows if not r["n_tokens"])
    assert all(np.isfinite(r["log_prob"]) for r in rows)
    assert P.score_documents(make_docs([])).collect() == []
    assert [r["log_prob"] for r in P.score_documents(make_docs([(1, None)])).collect()] == [0]


def test_words_beyond_the_vocabulary_have_their_own_probability(make_docs):
    """P(word) by the counts in its bucket: a word that stands once costs more than one that stands often."""
    common = "a b c d " * 50
    docs = make_docs([(1, common), (2, "twice"), (3, "twice"), (4, "once"), (5, "twice twice twice twice"), (6, None)])
    score = {r["doc_id"]: r["log_prob"] for r in P.score_documents(docs, vocabulary=4, n_classes=3, hidden=4, rounds=0).collect()}
    assert np.isclose(score[2] - score[4], np.log(6)) and score[2] == score[3] and score[6] == 0
    index, counts, total, repeated = P.build_vocabulary(docs, 4)
    assert sorted(index) == [b"a", b"b", b"c", b"d"] and counts.tolist() == [50, 50, 50, 50, 7] and total == 207
    assert [(bytes(r["word"]), r["count"]) for r in repeated.collect()] == [(b"twice", 6)]


def test_vocabulary_grows_with_the_corpus():
    assert P.vocabulary_size(0) == 8191 < P.vocabulary_size(10**8) < P.vocabulary_size(10**10)
    m = P.make_model({b"a": 0}, np.array([9, 3, 4]), 3, 2, 0)
    tokens, rare = m.tokens(b"A zz a y")
    assert rare == [b"zz", b"y"] and tokens[0] == tokens[2] == 0 and all(t in (1, 2) for t in tokens[[1, 3]])


def test_gradients_of_decisions_by_differences():
    rng = np.random.default_rng(0)
    m = P.make_model({b"w%d" % k: k for k in range(9)}, rng.integers(1, 50, 11), 4, 4, 1)
    p = {k: v.astype(np.float64) + (rng.normal(0, 0.3, v.shape) if k == "u" else 0) for k, v in m.params.items()}
    tokens = rng.integers(0, 11, 40)
    around, classes, steps = P.windows(tokens, 11), m.classes[tokens], m.paths.steps(tokens)

    def loss():
        h, z = P.forward(p, around)
        return (np.log1p(np.exp(-P.decide(p["u"], h, *steps))).sum() - z[np.arange(40), classes].sum()) / 40

    for name, g in P.gradients(p, around, classes, steps).items():
        for at in [tuple(rng.integers(0, n) for n in p[name].shape) for _ in range(8)]:
            keep = p[name][at]
            p[name][at] = keep + 1e-5
            up = loss()
            p[name][at] = keep - 1e-5
            down = loss()
            p[name][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_token_probabilities_sum_to_one_in_any_window():
    rng = np.random.default_rng(1)
    m = P.make_model({b"w%d" % k: k for k in range(20)}, rng.integers(1, 90, 23), 5, 4, 1)
    unigram = P.decide(m.params["u"], np.zeros((23, 4)), *m.paths.steps(np.arange(23)))
    logs = np.bincount(m.paths.steps(np.arange(23))[0], -np.log1p(np.exp(-unigram)), 23)
    assert np.allclose(logs, m.within, atol=1e-5)  # the counts, before any training
    m.params["u"] += rng.normal(0, 1, m.params["u"].shape).astype(np.float32)
    h, z = P.forward(m.params, np.repeat(rng.integers(0, 23, (4, 1)), 23, 1))
    position, node, sign = m.paths.steps(np.arange(23))
    each = z[np.arange(23), m.classes] + np.bincount(position, -np.log1p(np.exp(-P.decide(m.params["u"], h, position, node, sign))), 23)
    assert np.isclose(np.exp(each).sum(), 1)


def test_texts_score_above_shuffled_copies(make_docs):
    """All words are of one frequency and in one class: only which words stand around tells the order."""
    rng = np.random.default_rng(4)
    texts = [[f"w{(k + j) % 16}" for j in range(48)] for k in range(16) for _ in range(12)]
    shuffled = [list(rng.permutation(t)) for t in texts[:16]]
    docs = make_docs([(k, " ".join(t)) for k, t in enumerate(texts + shuffled)])
    score = {r["doc_id"]: r["log_prob"] for r in P.score_documents(docs, vocabulary=16, n_classes=2, hidden=16, rounds=3, batch_size=64).collect()}
    assert all(score[k] > score[len(texts) + k] + 10 for k in range(16))


def test_run_sums_are_those_of_reduceat_to_the_bit():
    rng = np.random.default_rng(5)
    for dtype in (np.float32, np.float64):
        n = np.concatenate([np.arange(1, 40), rng.permutation(np.arange(1, 300)) % 23 + 1, [500]])
        values, first = rng.normal(size=(n.sum(), 5)).astype(dtype), np.cumsum(n) - n
        order = rng.permutation(len(values))
        for some in (slice(None), n == 1, n > 16):
            assert (P._run_sums(values, first[some], n[some]) == np.stack([np.add.reduceat(values, [f, f + k], axis=0)[0] if f + k < len(values) else np.add.reduceat(values, [f], axis=0)[0] for f, k in zip(first[some], n[some], strict=True)])).all()
        assert (P._run_sums(values, first, n, order) == np.add.reduceat(values[order], first, axis=0)).all()


def test_texts_scored_together_score_as_alone():
    rng = np.random.default_rng(6)
    m = P.make_model({b"w%d" % k: k for k in range(30)}, rng.integers(1, 90, 33), 4, 4, 1)
    m.params["u"] += rng.normal(0, 1, m.params["u"].shape).astype(np.float32)
    texts = [rng.integers(0, 33, n) for n in (0, 5, 1, 0, 0, 70, 3, 200, 0)]
    for block in (1, 4, 64, 1000):
        assert np.allclose(P.log_probs(m, texts, block), [P.document_log_prob(m, t) for t in texts], rtol=1e-6)
    assert (P.log_probs(m, texts) == [P.document_log_prob(m, t) for t in texts]).all()  # to the bit, whatever stands beside
    assert P.log_probs(m, []).tolist() == [] and P.log_probs(m, [texts[0]]).tolist() == [0]


def test_words_are_counted_as_the_model_splits_them(spark, odd_docs, make_docs, monkeypatch):
    docs = odd_docs.unionByName(make_docs([(50, "A\x0bB\tc\x0cd e f É é\r\nA a"), (51, "x\x1cy \x00 z")]), allowMissingColumns=True)
    want = Counter(w for r in docs.collect() for w in (r["text"] or "").encode().lower().split())
    for held in (P.WORDS_HELD, 3):
        batch = pa.RecordBatch.from_arrays([pa.array([(r["text"] or "").encode() for r in docs.collect()], pa.binary())], names=["text"])
        monkeypatch.setattr(P, "WORDS_HELD", held)
        found = Counter()
        for part in P._count_words([batch]):
            found.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))
        assert found == want
    index, counts, total, repeated = P.build_vocabulary(docs, 40)
    assert total == sum(want.values()) == counts.sum()
    assert list(index) == sorted(want, key=lambda w: (-want[w], w))[:40] and counts[:40].tolist() == [want[w] for w in index]
    assert {bytes(r["word"]): r["count"] for r in repeated.collect()} == {w: n for w, n in want.items() if n > 1 and w not in index}


def test_training_leaves_no_shuffle_files(spark, make_docs):
    docs = make_docs([(k, f"a b c d{k % 7} e f") for k in range(400)])
    index, counts, total, _ = P.build_vocabulary(docs, 8)
    model = P.make_model(index, counts, 3, 4, 3)
    tokens = P.swept(P.tokenise(docs, spark.sparkContext.broadcast(model)))
    files = lambda: {f for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = {f.getName() for f in files()}
    P.train(tokens, model, total, 500, 2, 64, 0.5, 0.1)
    for _ in range(50):
        left = {f.getName() for f in files()} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_gradients_of_a_stream_are_those_of_its_windows():
    """Texts side by side in a stream, with nodes met seldom and often, as the sums over all windows."""
    rng = np.random.default_rng(7)
    m = P.make_model({b"w%d" % k: k for k in range(60)}, np.sort(rng.integers(1, 900, 63))[::-1], 4, 5, 1)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in m.params.items()}
    texts = [rng.integers(0, 63, n) ** 4 // 63**3 for n in (1, 40, 2, 300, 7)]
    tokens, edge = np.concatenate(texts), len(m.classes)
    stream = np.concatenate([[edge, edge], *(np.append(t, [edge, edge]) for t in texts)]).astype(np.int32)
    at, around = np.flatnonzero(stream != edge), np.concatenate([P.windows(t, edge) for t in texts], 1)
    position, node, sign = m.paths.steps(tokens)
    assert np.bincount(node).max() > 16 > np.bincount(node).min()
    begin = m.paths.begin[tokens]
    dense, rows = P.row_gradients(p | {"u": p["u"][:, :-1], "v": p["u"][:, -1]}, stream, at, m.classes[tokens], begin, m.paths.begin[tokens + 1] - begin, m.paths)
    h, z = P.forward(p, around)
    d = (np.exp(z) - np.eye(4)[m.classes[tokens]]) / len(tokens)
    g = -sign / (1 + np.exp(P.decide(p["u"], h, position, node, sign))) / len(tokens)
    dh, du, de = d @ p["w"].T, np.zeros_like(p["u"]), np.zeros_like(p["e"])
    np.add.at(dh, position, g[:, None] * p["u"][node, :-1])
    np.add.at(du, node, g[:, None] * np.append(h[position], np.ones((len(node), 1)), 1))
    dh[h <= 0] = 0
    for s in range(4):
        np.add.at(de, around[s], dh * p["a"][s])
        assert np.allclose(dense["a"][s], (dh * p["e"][around[s]]).sum(0))
    assert np.allclose(dense["w"], h.T @ d) and np.allclose(dense["c"], d.sum(0)) and np.allclose(dense["b"], dh.sum(0))
    row, u, v = rows["u"]
    assert sorted(row) == sorted(set(node)) and np.allclose(u, du[row, :-1]) and np.allclose(v, du[row, -1])
    row, e = rows["e"]
    assert set(row) == set(stream) and np.allclose(e, de[row])
    whole = P.gradients(p, around, m.classes[tokens], (position, node, sign))
    assert np.allclose(whole["u"], du) and np.allclose(whole["e"], de) and np.allclose(whole["a"], dense["a"])


def test_embeddings_are_read_once_for_all_windows():
    """Not once for each side, in both directions."""
    class Counted(np.ndarray):
        rows = 0

        def take(self, at, *args, **kwargs):
            Counted.rows += np.size(at)
            return np.asarray(self).take(at, *args, **kwargs)

    rng = np.random.default_rng(8)
    p, tokens = P.initial_params(5, 4, 1), rng.integers(0, 5, 100)
    p["e"] = p["e"].view(Counted)
    P.gradients(p, P.windows(tokens, 5), tokens)
    assert Counted.rows <= 500


def test_steps_do_not_depend_on_how_texts_come():
    """A shard trained from batches of one row, or with long texts cut, changes the same rows alike."""
    rng = np.random.default_rng(9)
    m = P.make_model({b"w%d" % k: k for k in range(40)}, np.sort(rng.integers(1, 900, 43))[::-1], 4, 5, 1)
    texts = [rng.integers(0, 43, n).astype(m.width) for n in (70_000, 1, 3, 500, 64, 2)]
    run = P._train(SimpleNamespace(value=m), 64, 0.5, 0.1)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([t.tobytes() for t in rows], pa.binary())], names=["shard", "tokens"])
    (a,), (b,) = run(iter([batch(texts)])), run(iter([batch([t]) for t in texts]))
    assert a.equals(b)
    weight = dict(zip(a.column(0).to_pylist(), a.column(1).to_pylist(), strict=True))
    tokens = np.concatenate(texts).astype(int)
    want = np.bincount(np.concatenate([P.windows(t.astype(int), 43) for t in texts], 1).ravel(), minlength=44)
    assert [weight.get(k, 0) for k in range(44)] == want.tolist()
    nodes = np.bincount(m.paths.steps(tokens)[1], minlength=len(m.params["u"]))
    assert [weight.get(44 + k, 0) for k in range(len(nodes))] == nodes.tolist()


def test_words_are_split_for_many_texts_at_once():
    rng = np.random.default_rng(10)
    words = np.array([b"%x" % w for w in rng.integers(0, 1 << 40, 20_000)], object)
    texts = [b" ".join(words[(rng.random(500) ** 3 * len(words)).astype(int)]) for _ in range(400)]
    odd = [b"", b" ", b"\x1c a\x0b\x0cB\x85 \xff\xfe q\x00 ", b"x\r\ny\t", "É é".encode()]
    m = P.make_model({w: k for k, w in enumerate(words[:5000])}, np.ones(5100, np.int64), 4, 4, 0)
    data = pa.array(texts + odd, pa.binary())
    found, ends = P.split_words(data)
    assert [found[i:j].to_pylist() for i, j in zip(ends, ends[1:])] == [t.lower().split() for t in texts + odd]
    tokens, at, rare, rare_at = m.tokens_of(data, m.vocabulary())
    for k, t in enumerate(texts + odd):
        one, others = m.tokens(t)
        assert (tokens[at[k] : at[k + 1]] == one).all() and rare[rare_at[k] : rare_at[k + 1]].to_pylist() == others == [w for w in t.lower().split() if w not in m.index]

    def least(f):
        times = []
        for _ in range(5):
            begin = time.thread_time()
            f()
            times.append(time.thread_time() - begin)
        return min(times)

    batch = pa.RecordBatch.from_arrays([data], names=["text"])
    assert least(lambda: list(P._count_words([batch]))) < 0.8 * least(lambda: Counter(w for t in data for w in t.as_py().lower().split()))
