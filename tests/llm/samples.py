"""Small tables for the tests of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrolens.llm.tables import table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use for their own results or on the way.
CLASHING = (
    "fp fingerprint component_id shard slot rank row rejected score lang_pred kept reason n_words w seed diagonal own "
    "labels ids leaf_chars script host path template purity part bad n a b root least draw dim "
    "found tree __found __tree __lang __score __rejected __kept __n_words __id __hash __n __leak_id __leak_hash _ item at".split()
)
LONG = "Lorem ipsum dolor sit amet. " * 40_000


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents from (doc_id, text) or whole rows."""
    return spark.createDataFrame([(*row, *(None,) * (5 - len(row))) for row in rows], DOCUMENTS)


def odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    rows = [
        (None, None, None, None, None),
        (None, "A text without an id, and then some more words.", "en", None, 3),
        (1, "", "en", "x", 0),
        (2, " \n\t ", None, "x", 3),
        (3, LONG, "la", "x", len(LONG)),
        (4, "12345 67890 !!! ???", "en", "x", 9),
        (5, "🎉 ▁ \x00 日本語", None, None, None),
        (6, "one", "en", "x", 3),
    ]
    some = table(spark, sf_dir, "documents").filter("doc_id >= 50").limit(40)
    both = documents(spark, rows + rows[:3] + rows[-2:]).unionByName(some)
    return both.selectExpr("*", *[f"'x' AS {name}" for name in CLASHING])


def nothing(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
