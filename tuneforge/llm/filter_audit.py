"""Interaction of five document filters, audited over all orders of applying them.

Each document fails a subset of the filters: a mask of five bits. Documents are summed to one
cell for each part and mask (32 at most for a part), so all that follows has a size that depends
on the number of parts alone. A Gray-code walk visits the 32 subsets of filters, toggling one at a
time: each cell has a counter of active filters that it fails, and only cells whose counter leaves
or reaches zero change the running survivors. The survivors after each subset are stored; step k
of an order is the difference of two stored states.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * A-Z characters > 2 * code
points; D holds any of ``#$%&*|``; E the same text stands under a smaller doc_id anywhere in the table.

Odd rows: null and empty texts are the empty text (A fails, and E for all but its least doc_id). A
null doc_id is neither smaller nor larger than any other, so such rows never fail E nor make others
fail it. Rows that repeat a doc_id and text all count, and none is a duplicate of the other. A null
source is the part ''. A doc_id with several label rows is good or toxic if any of them says so. An
empty table has no parts and no rows. Very long texts are one row of one task, split in memory.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import text_or_empty

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
BETWEEN = r"[\x20\x09-\x0D]+"
MEASURES = ["n", "good", "toxic"]


def content_mask(text: Column) -> Column:
    """Bits 0 to 3: filters A to D, which the text alone decides."""
    words = F.array_remove(F.split(text, BETWEEN, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < 200, distinct.cast("long") * 100 < n.cast("long") * 50, capitals * 100 > F.char_length(text).cast("long") * 2, text.rlike(r"[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic (0 or 1): one row for each labelled doc_id."""
    def any_one(name: str) -> Column:
        return F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("long"))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents (n), good and toxic ones fail just these filters.

    A text's copies are summed for each part before they meet (a group of copies of any size is a
    row for each part); E needs only the least doc_id of a text, whose rows alone do not fail it.
    """
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), content_mask(text).alias("mask"),
    ).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = flags(labels)
    rows = rows.join(known, rows["doc_id"] == known["label_id"], "left").select(
        "doc_id", "part", "digest", "mask", "n", *[(F.col("n") * F.coalesce(F.col(m), F.lit(0))).alias(m) for m in MEASURES[1:]],
    )
    # Per text and part: totals of rows with an id, of those at the least id, and of rows without.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *MEASURES)))
    texts = rows.groupBy("digest", "mask", "part").agg(
        least.alias("least"),
        *[F.sum(m).alias(f"all_{m}") for m in MEASURES],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(m)).otherwise(F.lit(0))).alias(f"free_{m}") for m in MEASURES],
    )
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    texts = texts.join(first, texts["digest"] == first["first_digest"])
    leads = F.coalesce(F.col("least.doc_id") == F.col("first_id"), F.lit(False))
    kept = [F.col(f"free_{m}") + F.when(leads, F.col(f"least.{m}")).otherwise(F.lit(0)) for m in MEASURES]
    pair = F.array(
        F.struct(F.col("mask").alias("mask"), *[k.alias(m) for k, m in zip(kept, MEASURES, strict=True)]),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), *[(F.col(f"all_{m}") - k).alias(m) for k, m in zip(kept, MEASURES, strict=True)]),
    )
    split = texts.select("part", F.explode(pair).alias("cell")).select("part", "cell.*")
    return split.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors after each subset of filters. ``counts``: [..., 32 masks, measures]; the result
    has the subset in the place of the mask."""
    states = np.empty_like(counts)
    failing = np.zeros(SUBSETS, np.int64)  # active filters that a cell fails
    running = counts.sum(axis=-2)
    subset = 0
    states[..., 0, :] = running
    masks = np.arange(SUBSETS)
    for step in range(1, SUBSETS):
        bit = step & -step
        subset ^= bit
        hit = (masks & bit) > 0
        if subset & bit:
            out = hit & (failing == 0)
            failing[hit] += 1
            running = running - counts[..., out, :].sum(axis=-2)
        else:
            failing[hit] -= 1
            back = hit & (failing == 0)
            running = running + counts[..., back, :].sum(axis=-2)
        states[..., subset, :] = running
    return states


def _steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of all orders and steps: the order's name, the step's filter, the subsets before and after."""
    names, letters, before, after = [], [], [], []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for f in order:
            names.append("".join(FILTERS[i] for i in order))
            letters.append(f)
            before.append(done)
            done |= 1 << f
            after.append(done)
    return names, np.array(letters), np.array(before), np.array(after)


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, letters, before, after = _steps()
    n_steps, masks = len(names), np.arange(SUBSETS)
    step = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), n_steps // len(FILTERS))
    order_names = pa.array(names)
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((SUBSETS, len(MEASURES)), np.int64)
            for cell in row["cells"]:
                counts[cell["mask"]] = [cell[m] for m in MEASURES]
            states = gray_walk(counts)
            lost = states[before] - states[after]
            fails = np.array([counts[(masks >> f) & 1 == 1, 0].sum() for f in range(len(FILTERS))])
            alone = np.array([counts[1 << f, 0] for f in range(len(FILTERS))])
            shapley = np.zeros(len(FILTERS), np.int64)
            np.add.at(shapley, letters, lost[:, 0])
            columns = [states[after, 0], lost[:, 0], fails[letters] - lost[:, 0], alone[letters], lost[:, 1], lost[:, 2], shapley[letters]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n_steps), order_names, pa.array(step), *[pa.array(c.astype(np.int64)) for c in columns]],
                names=[c.split()[0] for c in OUT.split(", ")],
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, each of the 120 orders and each step: documents kept and removed, those that
    failed the filter but were gone already, those that fail it alone, good and toxic ones lost, and the
    filter's removals summed over all orders."""
    per_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return per_part.mapInArrow(_audit, OUT)
