"""Word windows of texts with DataFrame functions only: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneforge.llm.common import text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII characters other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes the byte-wise path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), "")


def positions(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """row_id, doc_id, words, n_words and a row for each word position ``pos``; a text without
    words has one row with a null position. row_id tells repeated rows apart; ``keyed`` adds a
    hash of the text. No shuffle."""
    text = text_or_empty()
    extra = [F.xxhash64(text).alias("text_hash")] * keyed
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), *extra, words_of(text).alias("words"))
    return rows.select(*rows.columns, F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
