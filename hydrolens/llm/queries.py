"""The registered queries of this subpackage; each is an operator over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hydrolens.llm import ball_tree, collocations, config_packing, decision_list, decontaminate, language_id, license_scan, piece_codec, sharding, simhash_ball, tag_paths, token_trees, url_templates
from hydrolens.llm.oracle import ORACLE
from hydrolens.llm.tables import table, written

__all__ = ["ORACLE", "QUERIES"]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.overlaps(docs, items).drop("text_hash")


def op2_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labels(table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.learning_rows(docs))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("script", token_trees.sample_script())
    trees = token_trees.with_trees(docs, RANKS, public_tokenizers.PATTERN)
    counted = token_trees.edited(trees, RANKS, public_tokenizers.PATTERN)
    return counted.drop("text", "leaf_chars", "leaf_tokens")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    rows = decision_list.measured(docs.select("doc_id", "text")).drop("text")
    rows = written(rows, "quality-measures")
    rules = decision_list.learn(rows.filter(~decision_list.base_failed()), labels)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return decision_list.judge(rows, rules).select("doc_id", *base, "base_failed", "kept", "reason")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), PIECES)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ball_tree.search(docs, items)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(table(spark, sf_dir, "documents"), WORDS)


QUERIES = {
    query.__name__: query
    for query in (
        op1_decontamination,
        op2_license_notices,
        op3_shards,
        op4_main_text,
        op5_language,
        op6_url_verdicts,
        op7_token_counts,
        op8_quality,
        op9_simhash,
        op10_pieces,
        op11_ranked_search,
        op12_collocations,
        op13_packing,
    )
}
