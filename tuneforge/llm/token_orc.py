"""Token-ID output as ORC: run-length coded id lists with row indexes and Bloom filters.

Texts are range-partitioned by doc_id, sorted within partitions and encoded there; each
partition is one ORC file (a ``block``), so files follow each other in doc_id order. ORC codes
the id lists with integer run-length encoding; the row index and the Bloom filter on doc_id let
a lookup skip stripes and row groups, and a reader splits files at stripes. A row also holds
the number of tokens before it in its block, so that global starts need only the block totals.

Null and empty texts are written as the end id alone. Rows with a null doc_id come first; rows
that repeat a doc_id are all written, ordered by their text. An empty table gives an empty
folder. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuneforge.llm import hashing as H
from tuneforge.llm.common import blocks, text_or_empty

SCHEMA = "doc_id long, block int, block_start long, n_tokens int, ids array<int>"

#: Words kept with their ids by a worker process: the first ones, until too many others come.
CACHE_WORDS = 1_000_000
#: A space that is followed by white space or the end of the text, and how the vocabulary writes a space.
ODD, SPACE_MARK = r" (?:[\s\x0b\x1c-\x1f\x{85}\pZ]|$)", "\u0120"


class KnownWords:
    """Numbers of distinct words, from 0, in some 30 bytes beside each word's own: the words are one Arrow
    array, found by the binary search of a 64-bit hash and compared, so that words of one hash are told apart."""

    def __init__(self):
        self.texts, self.hashes, self.numbers = pa.array([], pa.large_string()), np.empty(0, np.uint64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.texts)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        """words: whole, without an offset, none of them empty."""
        offsets, data = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1), words.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        return H.word_hashes(buf, offsets[:-1], offsets[1:], fold=False)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for others."""
        out = np.full(len(words), -1, np.int64)
        if len(self) and len(words):
            hashes = self._hashes(words)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
            maybe = np.flatnonzero(self.hashes[at] == hashes)
            numbers = self.numbers[at[maybe]]
            same = pc.equal(self.texts.take(pa.array(numbers)), words.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
            out[maybe[same]] = numbers[same]
        return out

    def add(self, words: pa.Array) -> None:
        """Distinct words that ``find`` does not know; they get the next numbers."""
        if not len(words):
            return
        hashes = self._hashes(words)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.numbers = np.insert(self.numbers, at, (len(self) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.texts = pa.concat_arrays([self.texts, words])


def _plain(words: pa.Array | list[str]) -> pa.Array:
    """As large strings in buffers of their own."""
    return pa.concat_arrays([pa.array(words, pa.large_string()) if isinstance(words, list) else words.cast(pa.large_string()), pa.array([""], pa.large_string())])[:-1] if len(words) else pa.array([], pa.large_string())


class WordCachedEncoder:
    """Whole-text ids of a tokenizers file, with the ids of repeated words remembered.

    A byte-level pre-tokenizer without prefix space never joins what stands before a space
    with what follows it, if a character other than white space follows. Texts in which each space is
    followed by such a character are split at their spaces by Arrow, and the words of a block of texts are
    dictionary-encoded, so that Python sees each distinct word once a block. New words are encoded by the
    tokenizer, many in one call: a word's ids begin where a token begins with the space. The ids of all
    words are then gathered by their places in one array. Other texts, and all texts of
    other kinds of tokenizers, are encoded as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spaced
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.begins[i] = token.startswith(SPACE_MARK)
        self.cache_words = cache_words
        self.marks = {m: self._encode([m])[0] for m in ".,"}
        self._forget()

    def _forget(self) -> None:
        """words: the number of each kept word; its ids are pool[start:start + size]."""
        self.words, self.late = KnownWords(), 0
        self.start, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with their leading space, end to end, and the size of each."""
        joined = [" " + " ".join(words[k : k + 512]) for k in range(0, len(words), 512)]
        ids = np.concatenate(self._encode(joined)) if joined else np.empty(0, np.uint32)
        begin = np.flatnonzero(self.begins[ids])
        if len(begin) != len(words):  # a word that does not begin with the space's token
            parts = self._encode([" " + w for w in words])
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(begin, append=len(ids))

    def _keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.words), len(words)
        self.start, self.size = _grown(self.start, n + m), _grown(self.size, n + m)
        self.pool = _grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + m] = sizes
        self.words.add(words)
        self.used += len(ids)

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and size of the ids of distinct words in an array, which is the third result."""
        number = self.words.find(words)
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return self.start[number], self.size[number], self.pool[: self.used]
        late = words.take(pa.array(missing))
        texts = late.to_pylist()
        # a mark behind a letter is a piece of its own
        marked = [k for k, word in enumerate(texts) if word[-1:] in self.marks and word[-2:-1].isalpha()]
        stems = self.words.find(_plain([texts[k][:-1] for k in marked]))
        extra = {k: stem for k, stem in zip(marked, stems.tolist(), strict=True) if stem >= 0}
        extra_ids = [np.concatenate([self.pool[self.start[stem] : self.start[stem] + self.size[stem]], self.marks[texts[k][-1]]]) for k, stem in extra.items()]
        new = [k for k in range(len(texts)) if k not in extra]
        ids, sizes = self._encode_words([texts[k] for k in new])
        order = np.array([*new, *extra], np.int64)
        ids, sizes = np.concatenate([ids, *extra_ids]), np.concatenate([sizes, np.array([len(x) for x in extra_ids], np.int64)])
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        had = number >= 0
        start[had], size[had] = self.start[number[had]], self.size[number[had]]
        start[missing[order]], size[missing[order]] = self.used + np.cumsum(sizes) - sizes, sizes
        if len(self.words) + len(order) <= self.cache_words:
            self._keep(late.take(pa.array(order)), ids, sizes)
            return start, size, self.pool[: self.used]
        self.late += len(order)
        return start, size, np.concatenate([self.pool[: self.used], ids])

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (with the id ``end`` after each), and the number of each text's."""
        if self.late > 8 * self.cache_words:  # the words of these texts are others than those kept
            self._forget()
        n = len(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_word else np.ones(n, bool)
        # One list of pieces for each text: itself if it is odd, else its words; the first has no leading space.
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        counts = np.ones(n, np.int64)
        counts[~odd] = np.diff(split.offsets.to_numpy())
        ends = np.cumsum(counts)
        heads = ends - counts
        plain_heads = split.offsets.to_numpy()[:-1]
        flat = split.flatten()
        tail = np.ones(len(flat), bool)
        tail[plain_heads - split.offsets[0].as_py()] = False
        coded = flat.filter(pa.array(tail)).dictionary_encode()
        starts, sizes, pool = self._known(_plain(coded.dictionary))
        first = np.empty(n, object)
        first[odd] = texts.filter(pa.array(odd)).to_pylist()
        first[~odd] = flat.filter(pa.array(~tail)).to_pylist()
        head_ids = self._encode(first.tolist())
        head_sizes = np.array([len(h) for h in head_ids], np.int64)
        pool = np.concatenate([pool, *head_ids, np.array([0 if end is None else end], np.uint32)])
        at, size = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
        which = coded.indices.to_numpy()
        words = np.ones(len(at), bool)
        words[heads] = False
        at[words], size[words] = starts[which], sizes[which]
        at[heads], size[heads] = len(pool) - 1 - int(head_sizes.sum()) + np.cumsum(head_sizes) - head_sizes, head_sizes
        if end is not None:  # a piece of one id behind each text
            at, size = np.insert(at, ends, len(pool) - 1), np.insert(size, ends, 1)
            ends = ends + np.arange(1, n + 1)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.arange(int(before[-1])) + np.repeat(at - before[:-1], size)]
        return ids, np.diff(before[ends], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class SharedEncoder:
    """The encoder of a worker process: made by its first task, so that later ones find the words of the earlier
    ones. It goes out by broadcast, and the process drops it when it turns to a task of another job."""

    def __init__(self, path: str, cache_words: int):
        self.path, self.cache_words, self.made = path, cache_words, None

    def __reduce__(self):
        return SharedEncoder, (self.path, self.cache_words)

    def get(self) -> WordCachedEncoder:
        if self.made is None:
            self.made = WordCachedEncoder(self.path, self.cache_words)
        return self.made


def _strings(texts: pa.Array) -> pa.Array:
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _encode_blocks(shared, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, block = shared.value.get(), 0, None
        for batch in batches:
            doc_ids, block_ids, texts = batch.column(0), batch.column(1), batch.column(2)
            for i, j, _, _ in blocks(texts, 4_000_000):
                ids, sizes = encoder.encode_column(_strings(texts.slice(i, j - i)), end_id)
                if block_ids[i].as_py() != block:
                    block, before = block_ids[i].as_py(), 0
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), block_ids.slice(i, j - i), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), lists], names=["doc_id", "block", "block_start", "n_tokens", "ids"])
                pa.default_memory_pool().release_unused()  # what the words of a block took would else stay with the process
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, stripe_bytes: int = 16 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01, cache_words: int = CACHE_WORDS) -> None:
    """Encode every whole text, append ``end_id``, and write ORC files in ascending doc_id order."""
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", F.spark_partition_id().alias("block"), "text")
    )
    (
        rows.mapInArrow(_encode_blocks(docs.sparkSession.sparkContext.broadcast(SharedEncoder(tokenizer_path, cache_words)), end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.rows.between.memory.checks", str(index_rows // 2))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on doc_id reach the ORC reader, which prunes by its metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids of all documents before a row. Only one total for each
    block (file) goes through a window; the totals are broadcast, a row for each file."""
    totals = tokens.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return tokens.join(F.broadcast(offsets), "block").withColumn("start", F.col("offset") + F.col("block_start")).drop("offset")


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "block", "block_start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids (little-endian unsigned 32-bit), from the files."""
    sums = tokens.select("doc_id", "block", "block_start", "ids").mapInArrow(_checksums, "doc_id long, block int, block_start long, n_tokens long, ids_crc32 long")
    totals = tokens.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return sums.join(F.broadcast(offsets), "block").select("doc_id", (F.col("offset") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")
