"""Removal of repeated byte strings by prefix-free parsing of the corpus.

*Parse.* A rolling hash picks triggers: of the ``GAP`` byte 8-grams that begin at a start and after it,
the one with the least hash (the first of equal ones). It depends on the start's next ``LENGTH`` bytes
alone, so equal strings have their triggers at equal places. Neighbouring starts with one trigger
form a phrase: the bytes from its first start to ``LENGTH`` bytes past its last. Phrases overlap in
``LENGTH`` - 1 bytes, so each start belongs to one phrase, its string lies in it whole, and no phrase's
suffix of ``LENGTH`` bytes or more is a proper prefix of another such suffix.

*Dictionary.* Starts with equal strings have phrases with equal cores (the bytes from the trigger that
all strings of the phrase hold), so phrases whose core is found once are done. The others go to
the dictionary: distinct phrases, each with its first occurrence in the parse (by document, then
place). A later occurrence of a phrase repeats it wholly.

*Suffix order.* Dictionary phrases that share their core with another one may share strings. These
phrases are parsed once more, into parts of ``PART`` starts counted from the trigger, with a dictionary of
their own: it drops parts whose core is found once and merges equal ones. Of the parts that still
share a core, the suffixes of ``LENGTH`` bytes or more are sorted by their first ``LENGTH`` bytes
and then by corpus position (a range partition and a sort in each part, with the last string of each part
carried on to the next). Phrases never end within those bytes, so the order of the parse matters only
between equal strings, as the position. A suffix whose predecessor has the same ``LENGTH`` bytes also
starts earlier.

*Removal.* Bytes of repeated strings are removed; documents meet their list in one shuffle.

Phrases are told apart by 128-bit hashes and cores by 64-bit ones (a clash of cores costs work, not
results); suffixes are compared by their bytes.

Odd rows: a null text is empty. A null doc_id is before all others. Rows with one doc_id are ordered
by a hash of their text; equal ones are copies, all but one of which repeat the first. Texts of any length are
parsed in overlapping pieces. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneforge.llm.common import blocks, scratch_path, small, text_or_empty
from tuneforge.llm.hashing import _powers, mix

#: Bytes of a repeated string, and 8-grams of which a start's trigger is the least.
LENGTH, GAP, GRAM = 100, 64, 8
CORE = LENGTH - GAP + 1
#: Starts of one part of a phrase.
PART = 8
#: Bytes parsed at once; longer texts are cut into pieces that overlap.
PIECE = 1 << 20
_U = np.uint64
_BASES = (0x9E3779B97F4A7C55, 0xD1B54A32D192ED03)
_LOW = _U(0xFFFFFFFF)

SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def swept(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back. Shuffle files of the job are
    deleted with its end, not at some later collection of garbage."""
    spark = df.sparkSession
    path, before = scratch_path(spark), spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two hashes: a value for each byte, powers of the base and of its inverse."""
    n = PIECE + 2 * LENGTH
    return [(mix(np.arange(256, dtype=np.uint64) + _U(1 + 256 * i)), _powers(b, n), _powers(pow(b, -1, 1 << 64), n)) for i, b in enumerate(_BASES)]


def _sums(buf: np.ndarray, which: int) -> np.ndarray:
    table, power, _ = _tables()[which]
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[buf] * power[: len(buf)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * _tables()[which][2][start] ^ (stop - start).astype(np.uint64))


def parse(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first start and number of starts of each phrase of the texts that lie side by side in
    ``buf`` and stop at ``ends``."""
    n = len(buf)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3
    padded = np.zeros(n + GRAM, np.uint8)
    padded[:n] = buf
    grams = np.ndarray((n,), "<u8", padded.data, strides=(1,)) * _U(0x9FB21C651E98DF25)
    grams ^= grams >> _U(29)
    grams *= _U(0xBF58476D1CE4E5B9)
    grams &= ~_LOW
    grams |= np.arange(n, dtype=np.uint64)
    step = 1
    while step < GAP:  # the least of 2, 4, ... GAP neighbours; ties go to the first
        np.minimum(grams[:-step], grams[step:], out=grams[:-step])
        step *= 2
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    starts = np.flatnonzero(stop - np.arange(n) >= LENGTH)
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    trigger = (grams[starts] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    return trigger[new], starts[new], np.diff(new, append=len(starts))


def _packed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch side by side, up to PIECE bytes: rows, place of each in its text, bytes, ends. A
    longer text is given in pieces that overlap, so that each start has its bytes in one of them."""
    for i, j, buf, offsets in blocks(batch.column("data"), PIECE):
        if len(buf) <= PIECE:
            yield np.arange(i, j), np.zeros(j - i, np.int64), buf, offsets[1:]
        else:
            for at in range(0, len(buf) - LENGTH + 1, PIECE):
                piece = buf[at : at + PIECE + LENGTH - 1]
                yield np.array([i]), np.array([at]), piece, np.array([len(piece)])


Cores = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def phrases(buf: np.ndarray, ends: np.ndarray) -> Cores:
    """First start, number of starts, and core (begin, end) of each phrase."""
    trigger, first, n = parse(buf, ends)
    return first, n, trigger, trigger + CORE


def parts(buf: np.ndarray, ends: np.ndarray) -> Cores:
    """The same of the parts of phrases: runs of ``PART`` starts, counted back from the trigger."""
    trigger, first, n = parse(buf, ends)
    low, high = (trigger - first - n + 1) // PART, (trigger - first) // PART  # parts of the last and of the first start
    some = high - low + 1
    of = np.repeat(np.arange(len(first)), some)
    q = np.repeat(high + 1, some) - 1 - (np.arange(len(of)) - np.repeat(np.cumsum(some) - some, some))
    core = trigger[of] - PART * q
    begin, stop = np.maximum(first[of], core - PART + 1), np.minimum((first + n)[of], core + 1)
    return begin, stop - begin, core, core + LENGTH - PART + 1


def _cores(cut: Callable[..., Cores]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, ends in _packed(batch):
                _, _, begin, stop = cut(buf, ends)
                core, n = np.unique(_hashes(_sums(buf, 0), 0, begin, stop), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(n)], names=["core", "n"])
    return run


def _occurrences(cut: Callable[..., Cores]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = batch.column("base").to_numpy()
            for rows, places, buf, ends in _packed(batch):
                first, n, begin, end = cut(buf, ends)
                text = np.searchsorted(ends, first, side="right")
                begins = np.concatenate([[0], ends[:-1]])
                sums = _sums(buf, 0), _sums(buf, 1)
                stop = first + n - 1 + LENGTH
                hashes = [_hashes(sums[0], 0, begin, end), *(_hashes(s, i, first, stop) for i, s in enumerate(sums))]
                take = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(h.view(np.int64)) for h in hashes), *(batch.column(c).take(take) for c in KEY), pa.array(first - begins[text] + (places + bases[rows])[text]), pa.array(n.astype(np.int16))],
                    names=["core", "f1", "f2", *KEY, "at", "n"],
                )
    return run


#: A document by its id and its number among the rows of that id; the place of a piece of its text.
KEY = ["doc_id", "nth", "base"]
_TEXT = "doc_id long, nth int, base long, data binary"
_OCCURRENCE = "core long, f1 long, f2 long, doc_id long, nth int, base long, at long, n short"
#: Kinds of rows that meet a document: an occurrence of a phrase, a first one, the same of parts, a repeated start, the text.
OCCURRENCE, FIRST, PART_OCCURRENCE, FIRST_PART, START, TEXT = range(6)


def _resolved(texts: DataFrame, cut: Callable[..., Cores]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of what ``cut`` makes of the texts whose cores are found twice or more, the first
    occurrence of each distinct one, and those that share their core with another."""
    repeated = texts.mapInArrow(_cores(cut), "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("core").alias("known"))
    found = texts.mapInArrow(_occurrences(cut), _OCCURRENCE)
    found = swept(found.join(swept(repeated), F.col("core") == F.col("known"), "left_semi"))
    dictionary = swept(found.groupBy("core", "f1", "f2", "n").agg(F.min(F.struct("doc_id", "nth", "at", "base")).alias("first")).select("core", "n", "first.*"))
    shared = dictionary.groupBy("core").count().where("count > 1").select(F.col("core").alias("known"))
    return found, dictionary, dictionary.join(shared, F.col("core") == F.col("known"), "left_semi")


def _meeting(texts: DataFrame, *notes: tuple[int, DataFrame]) -> DataFrame:
    """Texts and notes (key, at, n) on them, dealt by key, notes in order before the text: a
    streaming cogroup that holds one text at a time."""
    rows = texts.select(*KEY, F.lit(TEXT).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("short").alias("n"), "data")
    for kind, df in notes:
        rows = rows.unionByName(df.select(*KEY, F.lit(kind).alias("kind"), "at", F.col("n").cast("short").alias("n"), F.lit(None).cast("binary").alias("data")))
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "kind", "at")


Notes = dict[int, tuple[np.ndarray, np.ndarray]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, Notes, pa.Buffer]]:
    """Each text of ``_meeting``: its key, whether it is a copy of the row before, its notes by kind (at, n)."""
    key, notes, copy = None, {}, False
    for batch in batches:
        if not len(batch):
            continue
        ids, kinds, ats, ns = batch.column("doc_id"), *(batch.column(c).to_numpy() for c in ("kind", "at", "n"))
        known, filled = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        columns = [known, filled, batch.column("nth").to_numpy(), batch.column("base").to_numpy(), kinds]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0) | (kinds[1:] == TEXT)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(batch)]])
        starts = cuts[:-1]
        values = zip(starts.tolist(), cuts[1:].tolist(), known[starts].tolist(), *(c[starts].tolist() for c in columns[1:]), strict=True)
        for a, b, has_id, doc_id, nth, base, kind in values:
            own = doc_id if has_id else None, nth, base
            if key != own:
                key, notes, copy = own, {}, False
            if kind == TEXT:
                yield own, copy, notes, batch.column("data")[a].as_buffer()
                copy = True
            else:
                old, now = notes.get(kind), (ats[a:b], ns[a:b])
                notes[kind] = now if old is None else tuple(np.concatenate(x) for x in zip(old, now, strict=True))


def _phrase_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of dictionary phrases, each a text of its own."""
    for (doc_id, nth, _), copy, notes, value in _met(batches):
        if copy or FIRST not in notes:
            continue
        data = value.to_pybytes()
        at, n = notes[FIRST]
        pieces = [data[a : a + k - 1 + LENGTH] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
        m = len(at)
        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * m, pa.int64()), pa.array([nth] * m, pa.int32()), pa.array(at), pa.array(pieces, pa.binary())], names=[*KEY, "data"])


_SUFFIX = "prefix binary, doc_id long, nth int, at long"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of dictionary parts by their first LENGTH bytes, gathered over several phrases."""
    held, keys, ats = [], [], []

    def give() -> pa.RecordBatch:
        data = np.concatenate(held)
        strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())
        out = pa.RecordBatch.from_arrays([strings, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(np.concatenate(ats))], names=["prefix", "doc_id", "nth", "at"])
        held.clear(), keys.clear(), ats.clear()
        return out

    for key, copy, notes, value in _met(batches):
        if copy or FIRST_PART not in notes:
            continue
        first, n = notes[FIRST_PART]
        size = n.astype(np.int64)
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        held.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(value, np.uint8), LENGTH)[at - key[2]])
        keys.extend([key[:2]] * len(at))
        ats.append(at)
        if len(keys) > 8192:
            yield give()
    if keys:
        yield give()


_ORDERED = "doc_id long, nth int, at long, part int, first binary, last binary"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, those whose predecessor has the same first bytes; then one row with the part's
    first suffix and its first and last string, for the seam to the part before."""
    part, seam, last = TaskContext.get().partitionId(), None, None

    def rows(doc_id, nth, at, ends=None) -> pa.RecordBatch:  # noqa: ANN001
        n = len(at)
        a, b = ends or (None, None)
        return pa.RecordBatch.from_arrays([doc_id, nth, at, pa.array(np.full(n, part, np.int32)), pa.array([a] * n, pa.binary()), pa.array([b] * n, pa.binary())], names=[c.split()[0] for c in _ORDERED.split(", ")])

    for batch in batches:
        if not len(batch):
            continue
        column = batch.column("prefix")
        data = np.frombuffer(pa.concat_arrays([column]).cast(pa.binary(LENGTH)).buffers()[1], np.uint8).reshape(-1, LENGTH)[: len(batch)]
        same = np.empty(len(batch), bool)
        same[1:] = (data[1:] == data[:-1]).all(1)
        same[0] = last is not None and data[0].tobytes() == last
        if seam is None:
            seam = [batch.column(c).slice(0, 1) for c in ("doc_id", "nth", "at")], data[0].tobytes()
        last = data[-1].tobytes()
        take = pa.array(np.flatnonzero(same))
        if len(take):
            yield rows(*(batch.column(c).take(take) for c in ("doc_id", "nth", "at")))
    if seam is not None:
        yield rows(*seam[0], (seam[1], last))


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def removed_mask(size: int, notes: Notes, copy: bool) -> np.ndarray:
    """Which bytes of a text go: those of later occurrences of phrases and parts, of repeated starts, and
    all strings of a copy of an earlier row."""
    if copy and size >= LENGTH:
        return np.ones(size, bool)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    runs = [notes.get(START, none)]
    for every, first in ((OCCURRENCE, FIRST), (PART_OCCURRENCE, FIRST_PART)):
        at, n = notes.get(every, none)
        later = ~np.isin(at, notes.get(first, none)[0])
        runs.append((at[later], n[later]))
    begin = np.concatenate([r[0] for r in runs])
    end = np.concatenate([r[0] + r[1].astype(np.int64) for r in runs]) - 1 + LENGTH
    return np.cumsum(np.bincount(begin, minlength=size + 1)[:size] - np.bincount(end, minlength=size + 1)[:size]) > 0


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [c.split()[0] for c in _KEPT.split(", ")], [pa.int64()] * 4 + [pa.binary()]
    rows, size = [], 0

    def give() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows.clear()
        return out

    for (doc_id, _, _), copy, notes, value in _met(batches):
        if not notes and not copy:
            rows.append((doc_id, value.size, 0, 0, value.to_pybytes()))
        else:
            text = np.frombuffer(value, np.uint8)
            gone = removed_mask(len(text), notes, copy)
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
            rows.append((doc_id, len(text), int(gone.sum()), spans, text[~gone].tobytes()))
        size += value.size
        if size > PIECE:
            yield give()
            size = 0
    if rows:
        yield give()


def _texts_of(docs: DataFrame) -> DataFrame:
    """Texts by key. Rows that share a doc_id are numbered by a hash of their text; ids that are not
    shared need no number, so only those of shared ids are worked out."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("data"))
    ids = rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared"))
    pairs = rows.select("doc_id", "text_hash").join(small(swept(ids)), F.col("doc_id").eqNullSafe(F.col("shared")), "left_semi").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash")) - 1
    later = pairs.select(F.col("doc_id").alias("later_id"), F.col("text_hash").alias("later_hash"), nth.alias("nth")).where("nth > 0")
    same = F.col("doc_id").eqNullSafe(F.col("later_id")) & (F.col("text_hash") == F.col("later_hash"))
    numbered = rows.join(small(swept(later)), same, "left")
    return numbered.select("doc_id", F.coalesce("nth", F.lit(0)).alias("nth"), F.lit(0).cast("long").alias("base"), "data")


def _of_document(rows: DataFrame) -> DataFrame:
    """Notes on a phrase as notes on its document."""
    return rows.withColumn("base", F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each document."""
    texts = _texts_of(docs)
    found, dictionary, shared = _resolved(texts, phrases)
    phrase_texts = swept(_meeting(texts, (FIRST, shared)).mapInArrow(_phrase_texts, _TEXT))
    part_found, part_dictionary, part_shared = _resolved(phrase_texts, parts)
    suffixes = _meeting(phrase_texts, (FIRST_PART, part_shared)).mapInArrow(_suffixes, _SUFFIX)
    order = ["prefix", "doc_id", "nth", "at"]
    ordered = swept(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_repeats, _ORDERED))
    # One row a part: whether its first string is the last one of the part before.
    seams = ordered.where("first IS NOT NULL").withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("first = before")
    starts = ordered.where("first IS NULL").select(*order[1:]).unionByName(seams.select(*order[1:])).withColumn("n", F.lit(1)).withColumn("base", F.lit(0).cast("long"))
    parts_of = (PART_OCCURRENCE, _of_document(part_found)), (FIRST_PART, _of_document(part_dictionary))
    return _meeting(texts, (OCCURRENCE, found), (FIRST, dictionary), *parts_of, (START, starts)).mapInArrow(_remove, _KEPT)
