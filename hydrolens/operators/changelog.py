"""Change logs of keyed values: newest entries, snapshot at a time, lookup, listing, deletion.

Entries are ordered by time, then by number. A null key is a key like any other. An entry
that was sent twice counts once; of entries equal in key, time and number the one with the
largest ``(op, value, expire_s)`` counts, nulls smallest.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions import text
from hydrolens.operators.slicing import join_same

ENTRY = ("key", "seq", "ts", "op", "value", "expire_s")


def position() -> Column:
    """Time and number as one decimal of fixed width; an entry without number comes first.

    Its largest value per key is found by hash aggregation; a struct's would be by sorting.
    """
    micros = F.unix_micros("ts").cast("decimal(18,0)")
    number = F.coalesce(F.col("seq"), F.lit(-(2**63))).cast("decimal(20,0)")
    return micros * F.lit("20000000000000000000").cast("decimal(20,0)") + number


def newest(log: DataFrame, at: datetime | None = None) -> DataFrame:
    """The newest entry of each key up to a time (all times without one), deletes included.

    It is a log of its own: with the entries that came since, late ones too, it
    gives the snapshots that the whole log gives, from its time on. So it serves as
    the base from which a long log is replayed.
    """
    known = log.select(*ENTRY).filter(F.col("ts").isNotNull())
    if at is not None:
        known = known.filter(F.col("ts") <= F.lit(at).cast("timestamp"))
    placed = known.withColumn("_position", position())
    # The newest place per key first: that aggregation is hash-based, while one that
    # carries the texts along would sort the whole log twice.
    last = placed.groupBy("key").agg(F.max("_position").alias("_position"))
    ends = join_same(placed, last, ["key", "_position"], "left_semi")
    # What is left are entries sent twice, and ties.
    ties = Window.partitionBy("key").orderBy(*[F.desc_nulls_last(name) for name in ("op", "value", "expire_s")])
    return ends.withColumn("_tie", F.row_number().over(ties)).filter("_tie = 1").select(*ENTRY)


def snapshot(log: DataFrame, at: datetime | None = None) -> DataFrame:
    """Live keys at a time: last write wins, deletes and expiry applied.

    A set without expiry (absent or 0) lives on and clears an earlier expiry. ``log`` may
    be a base of :func:`newest` with what came since.
    """
    clock = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    last = newest(log.filter(F.col("ts") <= clock))
    forever = F.coalesce(F.col("expire_s"), F.lit(0)) == 0
    expires = F.unix_micros("ts") + F.col("expire_s") * 1_000_000
    live = forever | (expires > F.unix_micros(clock))
    return last.filter((F.col("op") != "delete") & live).select("key", "value", "ts", "expire_s")


def lookup(live: DataFrame, keys: DataFrame) -> DataFrame:
    """Value of every asked key; ``found`` is false for a key that is not live."""
    values = live.select("key", "value", F.lit(True).alias("_live"))
    joined = join_same(keys, values, ["key"], "left")
    return joined.select("key", "value", F.coalesce("_live", F.lit(False)).alias("found"))


def list_keys(live: DataFrame, pattern: str = "*") -> DataFrame:
    """Live keys which match a glob; a null key matches none."""
    return live.filter(text.glob_match(F.col("key"), pattern)).select("key")


def delete_keys(live: DataFrame, keys: DataFrame) -> DataFrame:
    """The snapshot without the given keys."""
    return join_same(live, keys.select("key"), ["key"], "left_anti")
