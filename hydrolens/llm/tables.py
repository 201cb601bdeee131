"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.session import written

__all__ = ["fold", "hidden", "hidden_prefix", "lower_ascii", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(parts: list[Column]) -> Column:
    """Sum of columns."""
    return reduce(operator.add, parts)


def hidden(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hidden_prefix(df: DataFrame) -> str:
    """A beginning that no column's name has."""
    prefix = "_"
    while any(column.startswith(prefix) for column in df.columns):
        prefix += "_"
    return prefix
