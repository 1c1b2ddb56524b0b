"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
result is written as Parquet and read again as the next one's documents. All but the last return
the columns of their input. ``run`` applies them to the documents table.

Odd rows follow the operators' docstrings: null and empty texts fail the quality rule; rows that
repeat a document are reduced to one; null doc_ids are kept as documents of their own; an empty
table stays empty; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuneforge.llm import decontaminate, group_join, mixing, quality_forest, token_orc
from tuneforge.llm.common import scratch_path, without_rows, written
from tuneforge.llm.queries import table, tokenizer_path

#: Of the tokens that reach the mix, four fifths are taken.
MIX_SHARE, MIX_SEED = (4, 5), 11


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rule or the isolation forest rejects."""
    verdicts = quality_forest.quality_verdicts(docs, table(spark, sf_dir, "labels"))
    return without_rows(docs, written(verdicts.where("not kept").select("doc_id", "text_hash")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates."""
    return group_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents of each leaf up to its share of the token budget."""
    return mixing.mixed(docs, MIX_SHARE, MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids as ORC; return what the files hold for each document."""
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(docs, path, tokenizer_path(), end_id=2)
    return token_orc.digest(token_orc.read_tokens(spark, path))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", clean_of_benchmark), ("mix", mix), ("tokens", tokens)]

#: The forest of the first stage is not SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
