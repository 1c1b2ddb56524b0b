"""License scan by diagonal voting.

Each template's words are cut into rolling k-grams with their positions. A document's k-grams
are joined with them (broadcast: the templates are a fixed list); a match at document position p
and template position t votes for the diagonal p - t. Votes are aggregated for each diagonal as
a bit mask of template positions, diagonals at most ``max_gap`` apart are merged (words put in
or left out move the rest of a notice to a neighbouring diagonal), and a merged span is verified:
it gives its label if its mask covers ``min_cover`` of the template's grams. The base phrases are
templates too, of 2-grams; one stands where a single diagonal has all its grams. Matched grams
are compared word by word, so a hash collision cannot vote. DataFrame functions only.

Null and empty texts have no words, labels or places and a score of 0. Rows are judged one by
one, also repeated ones; null doc_ids are kept. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuneforge.llm.windows import positions

# The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Notices as their publishers word them, in lower case without punctuation.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
PHRASE_K, NOTICE_K = 2, 3


def templates() -> list[tuple[int, str, bool, int, list[str]]]:
    """(number, label, is it a base phrase, k, words)"""
    both = [(t, label, True, PHRASE_K) for t, label in PHRASES] + [(t, label, False, NOTICE_K) for t, label in NOTICES]
    return [(n, label, base, k, re.findall("[a-z0-9]+", text)) for n, (text, label, base, k) in enumerate(both)]


def values(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    """A small fixed table as a local relation, from SQL literals."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def grams(spark: SparkSession, k: int) -> DataFrame:
    """hash and words of each distinct k-gram, with the (template, position) places of it."""
    places: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for n, _, _, own, words in templates():
        assert len(words) - own < 63, "a mask holds 63 grams"
        for t in range(len(words) - own + 1 if own == k else 0):
            places.setdefault(tuple(words[t : t + k]), []).append((n, t))
    rows = ["(array({}), array({}))".format(", ".join(f"'{w}'" for w in g), ", ".join(f"named_struct('template', {n}, 'at', {t})" for n, t in p)) for g, p in places.items()]
    return values(spark, rows, "gram, places").select(F.xxhash64(*[F.col("gram")[j] for j in range(k)]).alias("hash"), F.col("gram").alias(f"gram{k}"), F.col("places").alias(f"places{k}"))


def _probe(rows: DataFrame, k: int) -> DataFrame:
    """Add the places of the k-gram at each position: probed by hash, verified word by word."""
    pos = F.col("pos")
    own = [F.get("words", pos + j) for j in range(k)]
    own_hash = F.when(pos + k <= F.col("n_words"), F.xxhash64(*own))
    table = grams(rows.sparkSession, k)
    joined = rows.join(F.broadcast(table), own_hash == table["hash"], "left").drop("hash")
    equal = F.lit(True)
    for j in range(k):
        equal &= own[j] == F.get(f"gram{k}", F.lit(j))
    return joined.withColumn(f"places{k}", F.when(equal, F.col(f"places{k}"))).drop(f"gram{k}")


def find_spans(docs: DataFrame, max_gap: int = 2, min_cover: float = 0.75) -> DataFrame:
    """A row for each merged span: row_id, doc_id, n_words, template, label, base, first and last
    word, cover and accepted; and a row with a null template for each document."""
    spark = docs.sparkSession
    rows = _probe(_probe(positions(docs), PHRASE_K), NOTICE_K)
    rows = rows.where(f"places{PHRASE_K} is not null or places{NOTICE_K} is not null or pos is null or pos = 0")
    none = F.array().cast("array<struct<template:int,at:int>>")
    place = F.concat(F.coalesce(f"places{PHRASE_K}", none), F.coalesce(f"places{NOTICE_K}", none))
    rows = rows.select("row_id", "doc_id", "n_words", "pos", F.explode_outer(place).alias("place"))
    known = [f"({n}, '{label}', {str(base).lower()}, {len(words) - k + 1}, {k})" for n, label, base, k, words in templates()]
    known_table = F.broadcast(values(spark, known, "template, label, base, n_grams, k"))
    votes = (
        rows.select("row_id", "doc_id", "n_words", F.col("place.template").alias("template"), (F.col("pos") - F.col("place.at")).alias("diagonal"), "pos", F.expr("shiftleft(1L, place.at)").alias("bit"))
        .groupBy("row_id", "doc_id", "n_words", "template", "diagonal")
        .agg(F.bit_or("bit").alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        .join(known_table, "template", "left")
    )
    along = Window.partitionBy("row_id", "template").orderBy("diagonal")
    far = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > max_gap)
    merged = (
        votes.withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(along))
        .groupBy("row_id", "doc_id", "n_words", "template", "label", "base", "n_grams", "k", "run")
        .agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    cover = F.bit_count("mask") / F.col("n_grams")
    accepted = F.when(F.col("base"), F.bit_count("mask") == F.col("n_grams")).otherwise(cover >= min_cover)
    return merged.select("row_id", "doc_id", "n_words", "template", "label", "base", "first", (F.col("last") + F.col("k") - 1).alias("last"), cover.alias("cover"), accepted.alias("accepted"))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: places of base phrases, labels and the best cover as score."""
    spans = find_spans(docs, **options)
    base = F.col("base") & F.col("accepted")
    joined = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, F.col("label")))))
    return spans.groupBy("row_id", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("first").cast("long"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("accepted")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("row_id")
