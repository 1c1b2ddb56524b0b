"""Registered queries of the operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneforge.llm import conversation_repair, decontaminate, filter_audit, group_join, license, mixing, pii, pseudo_likelihood, quality_forest, secrets, sql, suffix_dedup, token_orc, url_filter
from tuneforge.llm.common import base_spans, scratch_path, span_counts, span_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_orc.digest(token_orc.read_tokens(spark, path))


def _span_digest(spans: DataFrame, base: dict[str, str]) -> DataFrame:
    digest = F.sha2(span_text("spans", base_spans("spans", list(base))), 256)
    return spans.select("doc_id", *span_counts("spans", base), digest.alias("base_sha256"), span_text("spans").alias("spans"))


def op2_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")), {"assign": "n_assign", "access": "n_access", "hex": "n_hex"})


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_forest.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find_personal_data(table(spark, sf_dir, "documents")), {"email": "n_email", "ip": "n_ip", "card": "n_card", "phone": "n_phone"})


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents"))


def op8_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


MIX = {"share": (1, 2), "max_epochs": 2, "seed": 11}


def op10_mix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, leaves = mixing.plan(table(spark, sf_dir, "documents"), **MIX)
    names = {"m_domain": "domain", "m_lang": "lang", "m_source": "source"}
    return mixing.selection(rows, leaves, MIX["seed"]).withColumnsRenamed(names)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations"))))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_orc, op2_secret_novelty, op3_quality_forest, op4_pii_anchors, op5_license_diagonals, op6_pseudo_likelihood, op7_decontaminate, op8_url_aliases, op9_jaccard_groups, op10_mix_budgets, op11_conversation_repair, op12_suffix_dedup, op13_filter_audit)
}

SQL: dict[str, str] = {"op5_license_diagonals": sql.op5(), "op7_decontaminate": sql.op7(), "op8_url_aliases": sql.op8(), "op9_jaccard_groups": sql.op9(), "op10_mix_budgets": sql.op10(**MIX), "op11_conversation_repair": sql.op11(), "op13_filter_audit": sql.op13()}
