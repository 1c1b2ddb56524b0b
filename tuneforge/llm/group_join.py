"""N-gram Jaccard join by grouped prefixes, and its components.

A document's set holds the 64-bit hashes of its distinct word 5-grams. Under one global order
of all hashes, two sets that link share a hash within their prefixes. The order puts frequent
hashes last: a first pass counts the lower half of the hash space over all documents and calls
those in more than ``hot_df`` documents hot (at most ``MAX_HOT``: above, the threshold rises;
they are the only hashes that reach the driver); the order is lower half, upper half, hot. Any
order gives all links; this one keeps shared passages out of prefixes.

Documents with identical sets are one class, and classes with identical prefixes and sizes one
group; only a group's leader enters the posting lists. Groups are dealt into blocks by their
least listed hash and their size, and a group is a candidate of a block if it shares a list with
one of the block's groups and its size fits theirs. So group pairs are filtered block by block
and never written out: a list of m groups gives m rows for each of its few blocks. Groups are
then expanded to their classes, and each candidate's whole set is verified against the sets of
the block's classes at once. A task holds one block (``BLOCK_HASHES``) and streams candidates;
a block with many candidates is dealt to several tasks. It writes a link for each candidate and
for each two of the block's classes that a candidate joins, so that components are exact and
links grow with the rows.

Definitions for odd rows: null and empty texts have empty sets and link with nothing. Rows that
repeat a doc_id are separate sets under one id. Rows with a null doc_id link like all others (they
stand under a hash of their text), but cannot name a component: one without any doc_id has a null
component_id. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneforge.llm import hashing as H
from tuneforge.llm.common import blocks, small, text_or_empty, without_rows, written
from tuneforge.llm.components import components

MAX_HOT = 1 << 22

#: Ids of wanted texts that the driver holds at most, 8 bytes each; beyond, the join with the texts is shuffled.
MAX_IDS = 1 << 22
#: Rows of a table that Spark broadcasts (through the driver's heap, about 100 bytes each) at most.
SMALL_ROWS = 200_000

#: The sets of a block hold about so many hashes.
BLOCK_HASHES = 1_000_000
SIGNATURE = "doc_id long, text_hash long, n int, cls string, gkey long, prefix array<long>"
#: What a row is looked up by: its doc_id, or a hash of its text.
REF = "coalesce(doc_id, text_hash)"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-gram hashes of each text of a block; a shorter text is one gram."""
    starts, ends, rows = H.word_spans(buf, offsets)
    words = H.word_hashes(buf, starts, ends, fold=True)
    grams = H.window_hashes(words, k)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield H.window_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def prefix_of(grams: np.ndarray, hot: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first hashes of a set in the global order: not hot before hot, each by value."""
    size = len(grams) - (num * len(grams) + den - 1) // den + 1 if len(grams) else 0
    if len(hot) and size:
        top = (grams >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(hot, top), len(hot) - 1)
        is_hot = hot[at] == top
        if is_hot.any():
            grams = np.concatenate([grams[~is_hot], grams[is_hot]])
    return grams[:size]


def _text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and their hash (not computed where it is not used)."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))


def _lower_half(k: int):
    """The upper 32 bits of every hash below 2**63, one row each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in blocks(batch.column(1)):
                for_all = [s[: np.searchsorted(s, np.uint64(1 << 63))] for s in shingle_sets(buf, offsets, k)]
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(for_all) >> np.uint64(32)).astype(np.int32))], names=["top"])
    return run


def gathered(numbers: DataFrame, dtype) -> np.ndarray:
    """A column of whole numbers on the driver, sorted: it comes as bytes of whole batches, not row by row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy(zero_copy_only=False).astype(dtype).tobytes()], pa.binary())], names=["bytes"])

    return np.sort(np.frombuffer(b"".join(r[0] for r in numbers.mapInArrow(run, "bytes binary").collect()), dtype))


def hot_hashes(docs: DataFrame, k: int, hot_df: int) -> np.ndarray:
    """The upper halves of the hashes in more than ``hot_df`` documents, sorted; MAX_HOT at most."""
    tops = _text_rows(docs).drop("text_hash").mapInArrow(_lower_half(k), "top int")
    counts = written(tops.groupBy("top").count().where(F.col("count") > hot_df))
    while counts.where(F.col("count") > hot_df).count() > MAX_HOT:
        hot_df *= 2
    return np.sort(gathered(counts.where(F.col("count") > hot_df).select("top"), np.int32).view(np.uint32))


def _signatures(k: int, num: int, den: int, hot):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, j, buf, offsets in blocks(batch.column(1)):
                sizes, classes, keys, prefixes = [], [], [], []
                for grams in shingle_sets(buf, offsets, k):
                    prefix = prefix_of(grams, hot.value, num, den)
                    sizes.append(len(grams))
                    classes.append(xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else None)
                    keys.append(xxhash.xxh3_64_intdigest(prefix.tobytes(), len(grams)) - (1 << 63))
                    prefixes.append(prefix)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes, pa.int32()), pa.array(classes, pa.string()), pa.array(keys, pa.int64()), lists], names=["doc_id", "text_hash", "n", "cls", "gkey", "prefix"])
    return run


def _classed_texts(k: int, ids=None):
    """Texts with the class of their set; of all refs, or of those in a broadcast sorted array."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if ids is not None:
                ref, known = batch.column(0).to_numpy(), ids.value
                at = np.minimum(np.searchsorted(known, ref), max(len(known) - 1, 0))
                batch = batch.filter(pa.array(known[at] == ref if len(known) else np.zeros(len(ref), bool)))
            for i, j, buf, offsets in blocks(batch.column(1)):
                classes = [xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else None for grams in shingle_sets(buf, offsets, k)]
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.string()), batch.column(1).slice(i, j - i)], names=["cls", "text"])
    return run


class _Block:
    """The sets of a block's classes as one sorted index, and what its candidates have joined."""

    def __init__(self):
        self.names, self.sets, self.index, self.sizes = [], [], None, None

    def add(self, name: str, own: np.ndarray) -> None:
        self.names.append(name)
        self.sets.append(own)

    def _close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets])
        every = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.index, self.owner, self.sets = every[order], owner[order], []
        self.root = list(range(len(self.names)))

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def links(self, name: str, own: np.ndarray, num: int, den: int) -> Iterator[tuple[str, str]]:
        """Links of a candidate: one to the block, and those between its classes that are new."""
        if self.sizes is None:
            self._close()
        low, high = np.searchsorted(self.index, own, "left"), np.searchsorted(self.index, own, "right")
        hit = high > low
        if not hit.any():
            return
        at = np.concatenate([np.arange(a, b) for a, b in zip(low[hit].tolist(), high[hit].tolist())]) if (high - low).max() > 1 else low[hit]
        both = np.bincount(self.owner[at], minlength=len(self.names))
        linked = [h for h in np.flatnonzero(den * both >= num * (self.sizes + len(own) - both)).tolist() if self.names[h] != name]
        if linked:
            yield name, self.names[linked[0]]
            first = self._find(linked[0])
            for h in linked[1:]:
                if self._find(h) != first:
                    self.root[self._find(h)] = first
                    yield self.names[linked[0]], self.names[h]


def _verify(k: int, num: int, den: int):
    """Rows sorted by (block, part, role): a block's classes, then its candidates."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            keys = list(zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()))
            role, cls = batch.column("role").to_pylist(), batch.column("cls").to_pylist()
            found: list[tuple[str, str]] = []
            for i, _, buf, offsets in blocks(batch.column("text")):
                for r, own in enumerate(shingle_sets(buf, offsets, k), i):
                    if keys[r] != key:
                        key, block = keys[r], _Block()
                    if role[r] == 0:
                        block.add(cls[r], own)
                    elif block.names:
                        found.extend(block.links(cls[r], own, num, den))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], names=["a", "b"])
    return run


def verified(docs: DataFrame, classes: DataFrame, blocked: DataFrame, wanted: DataFrame, k: int, num: int, den: int, part_rows: int = 4096) -> DataFrame:
    """Links (a, b) of classes. blocked: (block, gkey) of a block's groups; wanted: of its candidates."""
    hubs = blocked.join(wanted.select("block").distinct(), "block", "left_semi").join(classes, "gkey").select("block", "cls")
    members = wanted.join(classes, "gkey").select("block", "cls")
    many = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    many = small(written(many), SMALL_ROWS)  # so that a block's many candidates are not dealt by block
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = members.join(many, "block").select("block", part.alias("part"), F.lit(1).alias("role"), "cls").union(
        hubs.join(many, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "cls"))
    rows = written(rows)
    ids = written(rows.select("cls").distinct().join(classes, "cls").select(F.col("rep").alias("ref")).distinct())
    texts = _text_rows(docs).selectExpr(f"{REF} AS ref", "text")
    if ids.limit(MAX_IDS + 1).count() <= MAX_IDS:
        known = docs.sparkSession.sparkContext.broadcast(gathered(ids, np.int64))
        texts = texts.mapInArrow(_classed_texts(k, known), "cls string, text binary")
    else:
        texts = texts.join(ids, "ref", "left_semi").mapInArrow(_classed_texts(k), "cls string, text binary")
    shipped = rows.join(texts, "cls").select("block", "part", "role", "cls", "text")
    return shipped.repartition("block", "part").sortWithinPartitions("block", "part", "role").mapInArrow(_verify(k, num, den), "a string, b string").distinct()


def link_classes(docs: DataFrame, sigs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """classes (cls, n, gkey, rep, least_id) and components (node, component) of the classes that link."""
    named = sigs.where("n > 0").withColumn("ref", F.expr(REF))
    classes = written(named.groupBy("cls", "n", "gkey").agg(F.min("ref").alias("rep"), F.min("doc_id").alias("least_id")))
    leaders = classes.groupBy("gkey", "n").agg(F.min(F.struct("rep", "cls")).alias("leader"), F.count(F.lit(1)).alias("n_classes"))
    leaders = written(leaders.select("gkey", "n", "leader.rep", "leader.cls", "n_classes"))

    # A row follows by its class: another row under its id may lead.
    followers = named.select("ref", "cls").join(leaders.select("cls", "rep"), "cls", "left").where("rep is null or rep <> ref")
    followers = written(followers.select("ref", F.xxhash64("cls").alias("of")).distinct())
    postings = named.select("ref", "gkey", "prefix", F.xxhash64("cls").alias("of")).join(small(followers, SMALL_ROWS), ["ref", "of"], "left_anti").select(F.explode("prefix").alias("token"), "gkey")
    along = Window.partitionBy("token").orderBy("gkey")
    lists = postings.select("token", "gkey", F.first("gkey").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lead("gkey").over(along).alias("next"))
    lists = lists.where("first <> gkey or next <> gkey").select("token", "gkey")
    lists = written(lists.union(leaders.where("n_classes > 1").select(F.col("gkey").alias("token"), "gkey")))

    # a group's block: its least listed hash, its size to within a factor, and a run of BLOCK_HASHES
    homes = lists.groupBy("gkey").agg(F.min("token").alias("home")).join(leaders.select("gkey", "n", "n_classes"), "gkey")
    homes = homes.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(den / num))))
    along = Window.partitionBy("home", "band").orderBy("n", "gkey").rowsBetween(Window.unboundedPreceding, 0)
    run = F.floor(F.sum(F.col("n").cast("long") * F.col("n_classes")).over(along) / BLOCK_HASHES)
    placed = written(homes.select("gkey", "n", "n_classes", F.xxhash64("home", "band", run).alias("block")))
    sizes = placed.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n_classes").alias("n_hubs"))
    in_lists = lists.join(placed, "gkey").join(sizes, "block")
    blocks_of = in_lists.select("token", F.col("block").alias("to"), "lo", "hi", "n_hubs").distinct()
    near = (den * F.col("n") >= num * F.col("lo")) & (den * F.col("hi") >= num * F.col("n"))
    alone = (F.col("block") == F.col("to")) & (F.col("n_hubs") == 1)
    wanted = in_lists.select("token", "gkey", "n", "block").join(blocks_of, "token").where(near & ~alone).select(F.col("to").alias("block"), "gkey").distinct()
    links = written(verified(docs, classes, placed.select("block", "gkey"), written(wanted), k, num, den))
    return classes, written(components(links))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, hot_df: int = 4) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (null for an empty set) and component_id (the least
    doc_id its links reach) of every row."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_hashes(docs, k, hot_df))
    sigs = written(_text_rows(docs).mapInArrow(_signatures(k, num, den, hot), SIGNATURE))
    classes, found = link_classes(docs, sigs, k, num, den)
    labelled = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least_id", F.coalesce("component", "cls").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = labelled.join(least, "component").groupBy("cls").agg(F.min("component").alias("component"), F.min("component_id").alias("component_id"))
    rows = sigs.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "cls").join(by_class, "cls", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "cls").alias("component"), component_id.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; rows without shingles stay."""
    found = written(near_duplicates(docs, **options)).where("component is not null")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    gone = found.join(first, "component").where(place != F.col("first"))
    left = without_rows(docs, written(gone.select("doc_id", "text_hash")))
    twice = written(found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    if not twice.head(1):
        return left
    marked = left.withColumn("__row_hash", F.xxhash64(text_or_empty()))
    again = F.broadcast(twice) if twice.count() <= 1_000_000 else twice
    again = again.select(F.col("doc_id").alias("__twice_id"), F.col("text_hash").alias("__twice_hash"))
    repeated = marked.join(again, F.col("doc_id").eqNullSafe(F.col("__twice_id")) & (F.col("__row_hash") == F.col("__twice_hash")), "left_semi")
    return without_rows(docs, written(gone.select("doc_id", "text_hash").union(twice))).union(repeated.dropDuplicates(["doc_id", "__row_hash"]).drop("__row_hash"))
