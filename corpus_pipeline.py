"""From raw documents to token ids: five stages, each an operator over all rows that
the one before kept.

1. ``language``: texts whose language is rejected go.
2. ``quality``: texts that the base rules or the learned rules reject go.
3. ``near_duplicates``: of each group of near-duplicates the row with the smallest id stays.
4. ``decontamination``: texts that hold a benchmark item go.
5. ``pieces``: the piece ids of each text, with digests of ids and decoded text.

All but the last hand on the columns of ``documents``. Null texts are rejected by the
first stage. Rows with a null id count as the last of their group; of rows that are
equal in id and fingerprint one stays. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.llm import decision_list, decontaminate, language_id, piece_codec, simhash_ball
from hydrolens.llm.queries import PIECES
from hydrolens.llm.tables import hidden_prefix, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(language_id.learning_rows(docs))
    p = hidden_prefix(docs)
    found = language_id.identify(docs, model, lang_col=f"{p}lang", score_col=f"{p}score", rejected_col=f"{p}rejected")
    return found.filter(~F.col(f"{p}rejected")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Written once: learning reads the measures, filtering the texts beside them.
    p = hidden_prefix(docs)
    rows = written(decision_list.measured(docs, prefix=p), "quality-rows")
    measures = rows.select("doc_id", *[F.col(f"{p}{name}").alias(name) for name in decision_list.MEASURES])
    passed = measures.filter(~decision_list.base_failed())
    rules = decision_list.learn(passed, table(spark, sf_dir, "labels"))
    return decision_list.judge(rows, rules, prefix=p).filter(F.col(f"{p}kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_ball.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(docs, PIECES, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: Fingerprints, learned models and piece encoding have no SQL form; ``tests/llm``
#: compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
