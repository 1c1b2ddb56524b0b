"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Every window of ``k`` words of a benchmark item (an item of fewer words is one window) goes into
a table of distinct windows with their hashes and items. Its size is counted; up to
``common.BROADCAST_ROWS`` windows it is broadcast, beyond that the join is shuffled. Documents
are scanned once: each position's window is hashed and probed, and hits are verified word by
word. Only hits and one row for each document are shuffled. DataFrame functions only.

Null and empty texts have no words and no hits; items without words have no windows. Rows are
judged one by one, also those that repeat a doc_id, and null doc_ids are kept. Items with a null
id mark words as hit but are not counted. An empty benchmark hits nothing; an empty documents
table gives an empty result. Columns other than doc_id and text are not read for the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import small, text_or_empty, without_rows, written
from tuneforge.llm.windows import positions, words_of


def benchmark_windows(items: DataFrame, k: int) -> DataFrame:
    """hash, size, window and items: each distinct window once."""
    words = items.select("item_id", words_of(text_or_empty()).alias("words")).where(F.size("words") > 0)
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - k, F.lit(0)))).alias("at"))
    windows = starts.select("item_id", F.slice("words", F.col("at") + 1, k).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("window").alias("hash"), F.size("window").alias("size"), "window", "items")


def covered(ranges: Column) -> Column:
    """How many positions a sorted array of (pos, size) ranges covers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    def step(acc: Column, r: Column) -> Column:
        end = r["pos"] + r["size"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(r["pos"], acc["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["end"], end).alias("end"))
    return F.aggregate(F.array_sort(ranges), start, step, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, items: DataFrame, k: int = 10, keyed: bool = False) -> DataFrame:
    """row_id, doc_id, n_words, n_hit, ranges (pos, size) and items of every document; text_hash too if ``keyed``."""
    grams = written(benchmark_windows(items, k))
    key = ["row_id", "doc_id", *["text_hash"] * keyed]
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # k sizes at most
    rows = positions(docs, keyed)
    if not sizes:
        probes = rows.withColumn("probe", F.lit(None).cast("struct<size:int,hash:bigint>"))
    else:
        pos = F.col("pos")
        one = [F.struct(F.lit(s).alias("size"), F.when(pos + s <= F.col("n_words"), F.xxhash64(F.slice("words", pos + 1, s))).alias("hash")) for s in sizes]
        probes = rows.withColumn("probe", one[0] if len(one) == 1 else F.explode(F.array(*one)))
    probes = probes.select(*key, "words", "n_words", "pos", F.col("probe.size").alias("at_size"), F.col("probe.hash").alias("at_hash"))
    joined = probes.join(small(grams), F.col("at_hash") == F.col("hash"), "left")
    equal = (F.col("at_size") == F.col("size")) & (F.slice("words", F.col("pos") + 1, F.col("at_size")) == F.col("window"))
    hits = joined.withColumn("items", F.when(equal, F.col("items"))).where("items is not null or pos is null or pos = 0")
    return (
        hits.groupBy(*key, "n_words")
        .agg(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "size"))).alias("ranges"), F.collect_set("items").alias("items"))
        .select(*key, "n_words", covered(F.col("ranges")).alias("n_hit"), F.array_sort("ranges").alias("ranges"), F.array_distinct(F.flatten("items")).alias("items"))
    )


def item_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda i: i.cast("string")))), 256)


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; all columns stay. Only the
    keys of hit rows are gathered, for an anti join."""
    found = find_contamination(docs.select("doc_id", "text"), items, k, keyed=True).where("n_hit > 0")
    return without_rows(docs, written(found.select("doc_id", "text_hash")))
