"""Masked pseudo-likelihood of documents.

Every token is predicted from the two tokens on either side, by a small bidirectional network
trained in numpy; a document's score is the sum of its conditional log-probabilities. Words are
counted over all documents; the most frequent ones are tokens, in a number that grows with the
corpus (``vocabulary_size``). All others are dealt into buckets by a hash; a bucket is a token too,
and a word in it has P(word | bucket) = its count / the bucket's, joined back from the distributed
counts. The scored documents are the counted ones, so every word has a count. Tokens are dealt into
classes of about equal mass by frequency (the buckets are the last class), and
P(token | window) = P(class | window) * P(token | class, window). The network embeds the tokens
around, scaled for each side; its hidden layer gives the class by a softmax and the token by the
binary decisions of a Huffman tree in each class, which start from the corpus counts.

Training reads all documents: they are dealt into shards by a hash of text and doc_id, as many as the
token total over ``shard_tokens``, so results do not depend on partitions or cores. A round
starts each shard from the same parameters and runs one pass of mini-batch SGD over it; the
shards' changes are averaged by a grouped sum over rows of parameters, weighted by the shard's tokens,
or by how often the shard met the token or decision a row belongs to. Only the vocabulary and the parameters reach the driver. Long texts are read in blocks
of windows. Scoring is one pass; only words beyond the vocabulary and a row for each document are shuffled.

Null and empty texts have no tokens and a score of 0 (mean null). Repeated rows are scored
alike; null doc_ids are kept; an empty corpus scores nothing. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import blocks, text_or_empty
from tuneforge.llm.suffix_dedup import swept

SIDES = (-2, -1, 1, 2)
SCORE_SCHEMA = "row long, doc_id long, n_tokens long, log_prob double"
TOKEN_SCHEMA = "row long, doc_id long, text_hash long, tokens binary, rare array<binary>"
#: Words that a task splits at a time, at 16 bytes each.
WORDS_HELD = 1 << 19


@dataclass
class Paths:
    """Decisions from the root of its class to each token: where a token's begin, their nodes and signs."""

    begin: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray

    def steps(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, node and sign of all decisions to the tokens, in order of position."""
        begin = self.begin.take(tokens)
        n = self.begin.take(tokens + 1) - begin
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(tokens)), n), self.nodes.take(at), self.signs.take(at)


@dataclass
class Model:
    """Class of each token (words, then buckets of other words), log P(token | class) by the counts,
    what a word's log count in its bucket is less by, the trees, parameters."""

    index: dict[bytes, int]
    classes: np.ndarray
    within: np.ndarray
    less: np.ndarray
    paths: Paths
    n_classes: int
    hidden: int
    params: dict[str, np.ndarray]

    @property
    def width(self) -> str:
        """How a token number is written: in 16 bits if all fit."""
        return "<u2" if len(self.classes) <= 1 << 16 else "<u4"

    def tokens(self, data: bytes) -> tuple[np.ndarray, list[bytes]]:
        """The tokens of a text, and its words that are in a bucket."""
        tokens, _, rare, _ = self.tokens_of(pa.array([data], pa.binary()), self.vocabulary())
        return tokens, rare.to_pylist()

    def vocabulary(self) -> pa.Array:
        return pa.array(self.index, pa.binary())

    def tokens_of(self, texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """The tokens of texts, one after the other, and where each text's begin and end; likewise their words
        that are in a bucket."""
        words, ends = split_words(texts)
        tokens = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy()
        rare = tokens < 0
        others = words.filter(pa.array(rare))
        known, n_buckets = len(self.index), len(self.classes) - len(self.index)
        tokens = tokens.astype(np.int32)
        tokens[rare] = [known + zlib.crc32(w) % n_buckets for w in others.to_pylist()]
        return tokens, ends, others, np.append(0, np.cumsum(rare))[ends]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (binary) as ``bytes.lower().split()`` gives them, and where each text's begin and end."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, ends = found.values, found.offsets.to_numpy()
    some = pc.not_equal(pc.binary_length(words), 0)  # texts that begin or end with a space, or are empty
    return words.filter(some).view(pa.binary()), np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[ends]


def make_paths(classes: np.ndarray, within: np.ndarray) -> tuple[Paths, np.ndarray]:
    """A Huffman tree over the tokens of each class, and the log odds of its decisions by the counts."""
    n = len(classes)
    parent, sign, odds = [-1] * n, [0] * n, []
    for members in np.split(np.argsort(classes, kind="stable"), np.flatnonzero(np.diff(np.sort(classes))) + 1):
        heap = [(float(np.exp(within[t])), int(t)) for t in members]
        heapq.heapify(heap)
        while len(heap) > 1:
            (less, a), (more, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = n + len(odds)
            sign[a], sign[b] = -1, 1
            parent.append(-1)
            sign.append(0)
            odds.append(math.log(more / less))
            heapq.heappush(heap, (less + more, parent[a]))
    begin, nodes, signs = [0], [], []
    for at in range(n):
        while parent[at] >= 0:
            nodes.append(parent[at] - n)
            signs.append(sign[at])
            at = parent[at]
        begin.append(len(nodes))
    return Paths(np.array(begin, np.int64), np.array(nodes, np.int32), np.array(signs, np.float32)), np.array(odds)


def initial_params(n_classes: int, hidden: int, seed: int, n_tokens: int | None = None, odds: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """e, a: embeddings and their scale on each side; b; w, c: classes; u: decisions, the last column their bias."""
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.3, ((n_tokens or n_classes) + 1, hidden)).astype(np.float32),
        "a": rng.normal(0, 1, (len(SIDES), hidden)).astype(np.float32),
        "b": np.zeros(hidden, np.float32),
        "w": rng.normal(0, 0.3, (hidden, n_classes)).astype(np.float32),
        "c": np.zeros(n_classes, np.float32),
    }
    if odds is not None:
        p["u"] = np.zeros((len(odds), hidden + 1), np.float32)
        p["u"][:, -1] = odds
    return p


def _hidden(p: dict[str, np.ndarray], stream: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """By column, the hidden values of the windows around all tokens of a stream but the first and last two, and the
    embeddings on each side. A token's embedding is read once for all windows around it."""
    e, scale = np.ascontiguousarray(p["e"].take(stream, axis=0).T), p["a"][:, :, None]
    sides = [e[:, 2 + s : len(stream) - 2 + s] for s in SIDES]
    h = sides[0] * scale[0]
    for k in range(1, len(SIDES)):
        h += sides[k] * scale[k]
    h += p["b"][:, None]
    np.maximum(h, 0, out=h)
    return h, sides


def _class_logs(p: dict[str, np.ndarray], h: np.ndarray, cuts: np.ndarray | tuple = ()) -> np.ndarray:
    """Class log-probabilities by column. The product with the classes is formed anew at each cut: its last bits
    depend on the columns beside."""
    z = np.concatenate([p["w"].T @ part for part in np.split(h, cuts, axis=1)], 1)
    z += p["c"][:, None]
    z -= z.max(0)
    z -= np.log(np.exp(z).sum(0))
    return z


def _stream(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as a stream of tokens, side by side, and the places of their targets in it."""
    return np.insert(around, 2, around[0], axis=0).T.ravel(), 5 * np.arange(around.shape[1]) + 2


def forward(p: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and class log-probabilities; around: a column of tokens for each side."""
    stream, at = _stream(around)
    h = _hidden(p, stream)[0].take(at - 2, axis=1)
    return np.ascontiguousarray(h.T), _class_logs(p, h).T


def decide(u: np.ndarray, h: np.ndarray, position: np.ndarray, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Signed log odds of decisions: log P of one is -log(1 + exp(-odds))."""
    return _odds(u.take(node, axis=0), h.take(position, axis=0), sign)


def _odds(met: np.ndarray, h: np.ndarray, sign: np.ndarray) -> np.ndarray:
    return sign * (np.einsum("ij,ij->i", met[:, :-1], h) + met[:, -1])


def _run_sums(values: np.ndarray, first: np.ndarray, n: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The sums of runs of n rows of ``values[order]``."""
    to = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(first - to, n)
    return np.add.reduceat(values.take(at if order is None else order.take(at), axis=0), to, axis=0)


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values, how often they stand."""
    if not len(rows):
        return rows, values, np.empty(0, np.int64)
    order, rows, first, n = _runs(rows)
    return rows, _run_sums(values, first, n, order), n


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of row numbers; the distinct ones, where their runs begin in that order, how long these are."""
    order = _order(rows)
    inside = rows.take(order)
    new = np.empty(len(rows), bool)
    new[0] = True
    np.not_equal(inside[1:], inside[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return order, inside.take(first), first, np.diff(first, append=len(rows))


def _ranked(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of runs of n places, the longest runs first, rank by rank; their runs; where each rank ends."""
    left = np.bincount(n)[::-1].cumsum()[::-1][1:]  # runs of more than k places
    ends = left.cumsum()
    run = np.arange(left.sum())
    run -= np.repeat(ends - left, left)
    at = first.take(run)
    at += np.repeat(np.arange(len(left)), left)
    return at, run, ends


def _ranked_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each run of values (or rows) that lie as ``_ranked`` says; takes the place of the first ones."""
    begin, *more = [0, *ends.tolist()]
    out = values[: more[0]] if more else values
    for end in more:
        if begin:
            out[: end - begin] += values[begin:end]
        begin = end
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    """A stable order of row numbers, 16 bits at a time: numpy sorts such integers by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    if rows.max() >> 16:
        order = order.take(np.argsort((rows.take(order) >> 16).astype(np.uint16), kind="stable"))
    return order


def _decision_gradients(p: dict[str, np.ndarray], h: np.ndarray, begin: np.ndarray, n: np.ndarray, paths: Paths) -> tuple[np.ndarray, tuple]:
    """What the decisions add to the gradient of the hidden values, and the nodes met with the gradients of
    their weights and biases. Each position has n decisions from ``begin`` in the paths: with the longest paths
    first, those of a rank lie side by side and are added as one slice; so do the positions that met a node.
    A node met more than 16 times takes its sum from a product with a row for all positions."""
    by = np.argsort((n.max() - n).astype(np.uint16), kind="stable")
    by = by[: np.count_nonzero(n)]
    at, run, ends = _ranked(begin.take(by), n.take(by))
    position, node, sign = by.take(run), paths.nodes.take(at), paths.signs.take(at)
    met, bent = p["u"].take(node, axis=0), h.take(position, axis=0)
    bent *= met
    g = bent @ np.ones(h.shape[1], h.dtype)
    g += p["v"].take(node)
    g *= sign
    np.exp(np.minimum(g, 80, out=g), out=g)
    g += 1
    g *= -len(h)
    np.divide(sign, g, out=g)
    met *= g[:, None]
    dh = np.zeros_like(h)
    dh[by] = _ranked_sums(met, ends)

    order, rows, first, n = _runs(node)
    longest = np.argsort(17 - np.minimum(n, 17).astype(np.uint8), kind="stable")
    rows, first, n = rows.take(longest), first.take(longest), n.take(longest)
    long = int(np.count_nonzero(n > 16))
    du, dv = np.empty((len(rows), h.shape[1]), h.dtype), np.empty(len(rows), h.dtype)
    at, _, ends = _ranked(first[long:], n[long:])
    at = order.take(at)
    some, bent = g.take(at), bent[: len(at)]
    np.take(h, position.take(at), axis=0, out=bent, mode="clip")
    bent *= some[:, None]
    du[long:], dv[long:] = _ranked_sums(bent, ends), _ranked_sums(some, ends)
    if long:
        n = n[:long]
        at = order.take(np.arange(n.sum()) + np.repeat(first[:long] - (np.cumsum(n) - n), n))
        each = np.zeros((long, len(h)), h.dtype)
        each[np.repeat(np.arange(long), n), position.take(at)] = g.take(at)
        np.matmul(each, h, out=du[:long])
        dv[:long] = each.sum(1)
    return dh, (rows, du, dv)


def row_gradients(p: dict[str, np.ndarray], stream: np.ndarray, at: np.ndarray, target: np.ndarray, begin: np.ndarray | None = None, n: np.ndarray | None = None, paths: Paths | None = None) -> tuple[dict[str, np.ndarray], dict[str, tuple]]:
    """Mean gradient of the negative log-probability of the target classes and decisions at the places ``at`` of
    a stream of tokens: whole arrays, and of embeddings (e) and decisions (u, their biases v) only the rows met.
    The gradients of all windows that a token stands in are added before they are dealt to its row."""
    inner, m = len(stream) - 4, len(target)
    h, sides = _hidden(p, stream)
    if m < inner:
        h = h.take(at - 2, axis=1)
    d = p["w"].T @ h
    d += p["c"][:, None]
    d -= d.max(0)
    np.exp(d, out=d)
    d /= d.sum(0)
    d[target, np.arange(m)] -= 1
    d /= m
    dh, rows = p["w"] @ d, {}
    if paths is not None and n.any():
        bent, rows["u"] = _decision_gradients(p, np.ascontiguousarray(h.T), begin, n, paths)
        dh += bent.T
    dh *= h > 0
    whole = {"b": dh.sum(1), "w": h @ d.T, "c": d.sum(1)}
    if m < inner:
        dh, some = np.zeros((len(dh), inner), dh.dtype), dh
        dh[:, at - 2] = some
    whole["a"] = np.stack([np.einsum("ij,ij->i", dh, side) for side in sides])
    de = np.zeros((len(dh), len(stream)), dh.dtype)
    for s, a in zip(SIDES, p["a"], strict=True):
        de[:, 2 + s : 2 + s + inner] += dh * a[:, None]
    rows["e"] = _row_sums(stream, np.ascontiguousarray(de.T))[:2]
    return whole, rows


def gradients(p: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray, steps: tuple | None = None) -> dict[str, np.ndarray]:
    """The same as whole arrays, with the tokens around each target and the decisions to it in order of position."""
    n = len(target)
    (stream, at), more = _stream(around), ()
    if steps is not None:
        position, node, sign = steps
        size = np.bincount(position, minlength=n)
        p = p | {"u": p["u"][:, :-1], "v": p["u"][:, -1]}
        more = (np.cumsum(size) - size, size, Paths(np.empty(0, np.int64), node, sign))
    whole, rows = row_gradients(p, stream, at, target, *more)
    whole["e"] = np.zeros_like(p["e"])
    whole["e"][rows["e"][0]] = rows["e"][1]
    if "u" in rows:
        at, du, dv = rows["u"]
        whole["u"] = np.zeros((len(p["u"]), du.shape[1] + 1), du.dtype)
        whole["u"][at] = np.concatenate([du, dv[:, None]], 1)
    return whole


def windows(classes: np.ndarray, edge: int) -> np.ndarray:
    """The classes (or tokens) around each position of a text, a row for each side."""
    padded = np.concatenate([[edge, edge], classes, [edge, edge]]).astype(np.int32)
    return np.stack([padded[2 + s : 2 + s + len(classes)] for s in SIDES])


def vocabulary_size(total: int) -> int:
    """Words that are tokens of their own: 8,191 at least, and with the square root of the corpus."""
    return max(8191, 4 * math.isqrt(total))


def _text_blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and last (exclusive) of blocks of texts; a large text stands alone."""
    for i, j, _, _ in blocks(column, 16 * WORDS_HELD):
        yield i, j


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, lower-cased and split as ``Model.tokens`` does; a word comes again in each block
    of texts."""
    for batch in batches:
        for i, j in _text_blocks(batch.column(0)):
            found = pc.value_counts(split_words(batch.column(0).slice(i, j - i))[0])
            if len(found):
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


def build_vocabulary(docs: DataFrame, vocabulary: int | None) -> tuple[dict[bytes, int], np.ndarray, int, DataFrame]:
    """The most frequent words over all documents, their counts (then those of the buckets of other
    words, one for every 32 words), the total, and the other words that stand more than once with their counts."""
    words = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(_count_words, "word binary, n long")
    counts = swept(words.groupBy("word").agg(F.sum("n").alias("count")))
    total = counts.agg(F.sum("count")).first()[0] or 0
    vocabulary = vocabulary or vocabulary_size(total)
    top = counts.orderBy(F.desc("count"), "word").limit(vocabulary).toPandas()
    index = {bytes(w): k for k, w in enumerate(top["word"])}
    others = counts.where("false")
    if len(top) == vocabulary:
        least, last = int(top["count"].iloc[-1]), bytes(top["word"].iloc[-1])
        others = counts.where((F.col("count") < least) | ((F.col("count") == least) & (F.col("word") > last)))
    n_buckets = max(1, vocabulary // 32)
    buckets = np.zeros(n_buckets, np.int64)
    for bucket, count in others.groupBy((F.crc32("word") % n_buckets).alias("bucket")).agg(F.sum("count")).collect():
        buckets[bucket] = count
    repeated = others.where("count > 1").select("word", "count")
    return index, np.append(top["count"].to_numpy(np.int64), buckets), int(total), repeated


def make_model(index: dict[bytes, int], counts: np.ndarray, n_classes: int, hidden: int, seed: int) -> Model:
    """Classes of about equal mass along the frequency order; the buckets have the last class to themselves."""
    mass, n = np.maximum(counts, 1).astype(np.float64), len(index)
    known = np.cumsum(mass[:n]) - mass[:n] / 2
    classes = np.minimum((known / max(mass[:n].sum(), 1) * (n_classes - 1)).astype(np.int64), n_classes - 2)
    classes = np.append(classes, np.full(len(mass) - n, n_classes - 1))
    sums = np.bincount(classes, mass, n_classes)
    less = np.append(np.zeros(n), np.log(mass[n:]))
    within = np.log(mass / sums[classes])
    paths, odds = make_paths(classes, within)
    return Model(index, classes.astype(np.int32), within, less, paths, n_classes, hidden, initial_params(n_classes, hidden, seed, len(classes), odds))


def _rows(p: dict[str, np.ndarray], hidden: int) -> np.ndarray:
    """All parameters as rows of hidden + 1 values: embeddings, decisions, then the others."""
    rest = np.concatenate([p[k].ravel() for k in "abcw"])
    rest = np.pad(rest, (0, -len(rest) % (hidden + 1))).reshape(-1, hidden + 1)
    return np.concatenate([np.pad(p["e"], ((0, 0), (0, 1))), p["u"], rest])


def _unrows(x: np.ndarray, like: dict[str, np.ndarray], hidden: int) -> dict[str, np.ndarray]:
    n, m = len(like["e"]), len(like["u"])
    out, rest, at = {"e": x[:n, :hidden], "u": x[n : n + m]}, x[n + m :].ravel(), 0
    for k in "abcw":
        out[k] = rest[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return {k: np.ascontiguousarray(v, np.float32) for k, v in out.items()}


def tokenise(docs: DataFrame, shared) -> DataFrame:
    """A number for each row, doc_id, text_hash, the token numbers of each text as 16- or 32-bit integers
    and its words beyond the vocabulary, in one pass."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_heap()
        model: Model = shared.value
        vocabulary, width = model.vocabulary(), np.dtype(model.width)
        for batch in batches:
            for i, j in _text_blocks(batch.column(3)):
                part = batch.slice(i, j - i)
                tokens, ends, rare, rare_ends = model.tokens_of(part.column(3), vocabulary)
                tokens = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends * width.itemsize).astype(np.int32)), pa.py_buffer(tokens.astype(width))])
                rare = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], tokens, rare], names=["row", "doc_id", "text_hash", "tokens", "rare"])

    text = text_or_empty()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, TOKEN_SCHEMA)


def rare_log_counts(tokens: DataFrame, repeated: DataFrame) -> DataFrame:
    """For each row, the sum of the log counts of its words beyond the vocabulary (0 for words that
    stand once, so that these are left out)."""
    words = tokens.select("row", F.explode("rare").alias("word"))
    return words.join(repeated.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.log("count")).alias("rare_log"))


def _keep_heap() -> None:
    """Free one large array: from then on the C library keeps the memory of smaller ones for the next, instead
    of giving it back to the system and having it mapped anew in every batch."""
    np.empty(30 << 20, np.uint8)


def _put_rows(to: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """``to[row] = values`` of whole rows, each written as one value."""
    one = np.dtype((np.void, to.dtype.itemsize * to.shape[1]))
    np.put(to.view(one).ravel(), row, values.view(one).ravel())


def _train(shared, batch_size: int, rate: float, row_rate: float):
    """Rows sorted by shard: one pass of SGD over each shard from the shared parameters, with
    steps of embeddings and decisions shortened by their own past gradients."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        _keep_heap()
        paths, edge = model.paths, len(model.classes)
        shard, p, past, met, seen, held, size = None, None, None, None, 0, [], 0
        between, sides = np.full(2, edge, np.int32), np.array(SIDES)[:, None]

        def step(force: bool) -> None:
            """One step for each whole batch of tokens held (with force, for the rest too). The first two tokens
            held and the last two are only read as neighbours."""
            nonlocal held, size, seen
            stream = np.concatenate(held)
            at = np.flatnonzero(stream[2:-2] != edge) + 2
            at = at if force else at[: len(at) - len(at) % batch_size]
            if not len(at):
                return
            for k in range(0, len(at), batch_size):
                part = at[k : k + batch_size]
                some = stream[part[0] - 2 : part[-1] + 3]
                tokens = stream.take(part)
                begin = paths.begin.take(tokens)
                dense, rows = row_gradients(p, some, part - (part[0] - 2), model.classes.take(tokens), begin, paths.begin.take(tokens + 1) - begin, paths)
                for name, g in dense.items():
                    p[name] -= np.float32(rate) * g
                for name, (row, g, *bias) in rows.items():
                    power = (g * g) @ np.ones(g.shape[1], np.float32)
                    if bias:
                        power += bias[0] * bias[0]
                    power /= g.shape[1] + len(bias)
                    power += past[name].take(row)
                    past[name][row] = power
                    shorter = np.float32(row_rate) / np.sqrt(power + np.float32(1e-20))
                    g *= shorter[:, None]
                    _put_rows(p[name], row, np.subtract(p[name].take(row, axis=0), g, out=g))
                    if bias:
                        p["v"][row] -= bias[0] * shorter
            met["e"] += np.bincount(stream.take(at + sides).ravel(), minlength=edge + 1)
            met["u"] += np.bincount(stream.take(at), minlength=edge)
            seen += len(at)
            held = [stream[at[-1] - 1 :]]
            size -= len(at)

        def result() -> pa.RecordBatch:
            # All decisions on the way to a token are met as often as it is.
            decided = np.bincount(paths.nodes, np.repeat(met["u"], np.diff(paths.begin)), len(p["u"])).astype(np.int64)
            change = _rows(p | {"u": np.concatenate([p["u"], p["v"][:, None]], 1)}, model.hidden).astype(np.float64) - _rows(model.params, model.hidden)
            weight = np.concatenate([met["e"], decided, np.full(len(change) - len(met["e"]) - len(decided), seen)])
            row = np.flatnonzero(weight)
            change = (change[row] * weight[row, None]).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(weight[row], pa.int64()), *(pa.array(x) for x in change.T)], names=["row", "weight", *(f"d{k}" for k in range(model.hidden + 1))])

        for batch in batches:
            shards = batch.column(0).to_pylist()
            for k in range(len(shards)):
                if shards[k] != shard:
                    if shard is not None:
                        step(True)
                        yield result()
                    shard, seen, held, size = shards[k], 0, [between], 0
                    p = {name: value.copy() for name, value in model.params.items() if name != "u"}
                    p |= {"u": model.params["u"][:, :-1].copy(), "v": model.params["u"][:, -1].copy()}
                    past = {name: np.zeros(len(p[name]), np.float32) for name in "eu"}
                    met = {"e": np.zeros(edge + 1, np.int64), "u": np.zeros(edge, np.int64)}
                tokens = np.frombuffer(batch.column(1)[k].as_py(), model.width).astype(np.int32)
                for at in range(0, len(tokens), 1 << 16):
                    held.append(tokens[at : at + (1 << 16)])
                    size += len(held[-1])
                    if size >= 16 * batch_size + 2:
                        step(False)
                held.append(between)
        if shard is not None:
            step(True)
            yield result()
    return run


def train(tokens: DataFrame, model: Model, total: int, shard_tokens: int, rounds: int, batch_size: int, rate: float, row_rate: float) -> Model:
    sc = tokens.sparkSession.sparkContext
    n_shards = max(1, -(-total // shard_tokens))
    # Copies of a text are dealt by their doc_id too; a shard is a task of its own.
    dealt = tokens.where(F.octet_length("tokens") > 0).select(F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(n_shards)).cast("int").alias("shard"), "tokens", "text_hash", "doc_id")
    dealt = dealt.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "text_hash", "doc_id").select("shard", "tokens")
    values = [f"d{k}" for k in range(model.hidden + 1)]
    for _ in range(rounds):
        fitted = dealt.mapInArrow(_train(sc.broadcast(model), batch_size, rate, row_rate), ", ".join(["row long", "weight long", *(f"{v} float" for v in values)]))
        mean = fitted.groupBy("row").agg(*((F.sum(v) / F.sum("weight")).cast("float").alias(v) for v in values))
        change = swept(mean).toArrow()
        params = _rows(model.params, model.hidden)
        params[change.column("row").to_numpy()] += np.stack([change.column(v).to_numpy() for v in values], 1)
        model.params = _unrows(params, model.params, model.hidden)
    return model


def log_probs(model: Model, texts: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """For each text, the sum over all positions of log P(token | both sides), in blocks of windows; those of
    short texts are taken together. A word in a bucket counts as one that stands once (its log count comes
    from ``rare_log_counts``)."""
    total = np.zeros(len(texts))
    if not len(texts):
        return total
    tokens, edge = np.concatenate(texts).astype(np.int32), len(model.classes)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    place = np.arange(len(tokens)) + 2 * (text + 1)
    stream = np.full(len(tokens) + 2 * (len(texts) + 1), edge, np.int32)
    stream[place] = tokens
    ends = np.cumsum([len(t) for t in texts])
    begin = np.concatenate([np.arange(end - len(t), end, block) for t, end in zip(texts, ends, strict=True)]).astype(np.int64)
    first = np.flatnonzero(np.diff(begin >> 11, prepend=-1))  # blocks that begin within 2,048 positions
    for i, j in pairwise([*first, len(begin)]):
        run = slice(begin[i], begin[j] if j < len(begin) else len(tokens))
        target, of, at = tokens[run], text[run] - text[run.start], place[run]
        by_column = _hidden(model.params, stream[at[0] - 2 : at[-1] + 3])[0].take(at - at[0], axis=1)
        z, h = _class_logs(model.params, by_column, begin[i + 1 : j] - begin[i]), np.ascontiguousarray(by_column.T)
        steps = model.paths.steps(target)
        odds = decide(model.params["u"], h, *steps)
        sums = np.bincount(of, z[model.classes.take(target), np.arange(len(target))] - model.less.take(target))
        sums -= np.bincount(of.take(steps[0]), np.log1p(np.exp(-np.abs(odds))) + np.maximum(-odds, 0), len(sums))
        total[text[run.start] : text[run.start] + len(sums)] += sums
    return total


def document_log_prob(model: Model, tokens: np.ndarray, block: int = 4096) -> float:
    """``log_probs`` of one text."""
    return float(log_probs(model, [tokens], block)[0])


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_heap()
        model: Model = shared.value
        for batch in batches:
            tokens = [np.frombuffer(x.as_py(), model.width) for x in batch.column(2)]
            length = np.array([len(t) for t in tokens], np.int64)
            part = np.cumsum(length) >> 16  # texts of about so many tokens at a time
            scores = [log_probs(model, tokens[i:j]) for i, j in pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(tokens)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(length), pa.array(np.concatenate([*scores, np.empty(0)]))], names=["row", "doc_id", "n_tokens", "log_prob"])
    return run


def score_documents(docs: DataFrame, vocabulary: int | None = None, n_classes: int = 32, hidden: int = 16, shard_tokens: int = 2_000_000, rounds: int = 1, batch_size: int = 1024, rate: float = 0.5, row_rate: float = 0.1, seed: int = 3) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every document."""
    if (vocabulary is not None and vocabulary < 1) or n_classes < 2:
        raise ValueError("vocabulary must be above 0 and n_classes above 1")
    sc = docs.sparkSession.sparkContext
    index, counts, total, repeated = build_vocabulary(docs, vocabulary)
    model = make_model(index, counts, n_classes, hidden, seed)
    tokens = swept(tokenise(docs, sc.broadcast(model)))
    model = train(tokens, model, total, shard_tokens, rounds, batch_size, rate, row_rate)
    scored = tokens.select("row", "doc_id", "tokens").mapInArrow(_score(sc.broadcast(model)), SCORE_SCHEMA)
    scored = scored.join(rare_log_counts(tokens, repeated), "row", "left")
    scored = scored.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("rare_log", F.lit(0.0))).alias("log_prob"))
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
