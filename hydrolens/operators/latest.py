"""Newest rows, latest state per device and rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.functions import text

MEASURES = ("ph", "temperature", "humidity", "conductivity", "distance", "water_level")


def _at_least_one(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit


def latest_n(readings: DataFrame, limit: int = C.LOG_READ_LIMIT) -> DataFrame:
    """The newest readings overall, newest first; no full sort."""
    return readings.orderBy(F.desc("ts"), F.desc("seq")).limit(_at_least_one(limit))


def history_n(readings: DataFrame, limit: int = C.HISTORY_LIMIT) -> DataFrame:
    """The newest readings of each device with their log id.

    Spark cuts each device to ``limit`` rows before the shuffle as well.
    """
    newest = Window.partitionBy("device_id").orderBy(F.desc("ts"), F.desc("seq"))
    ranked = readings.withColumn("position", F.row_number().over(newest))
    millis = F.unix_millis("ts")
    stream_id = F.concat(millis.cast("string"), F.lit("-"), F.col("seq").cast("string"))
    return ranked.filter(F.col("position") <= _at_least_one(limit)).withColumns(
        {"timestamp_ms": millis, "id": stream_id}
    )


def latest_state(readings: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Per device the last present value of every field, and the last arrival.

    Fields merge one by one, as in a keyed map: a field absent from the newest
    reading keeps its earlier value. Ordering by the arrival number keeps the
    aggregation hash-based, with partial results before the shuffle.
    """
    skip = ("device_id", "seq", "ts", "source")
    fields = fields or tuple(name for name in readings.columns if name not in skip)
    seq = F.col("seq")

    def last_present(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), seq)).alias(name)

    return readings.groupBy("device_id").agg(
        F.max_by("ts", "seq").alias("ts"), *[last_present(name) for name in fields]
    )


def device_status(
    state: DataFrame,
    now: datetime | None = None,
    offline_after: float = C.OFFLINE_AFTER_SECONDS,
) -> DataFrame:
    """Latest state with ``status``; a stale device reads 0 on every measure."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    age = F.unix_micros(clock) - F.unix_micros("ts")
    stale = age > int(offline_after * 1_000_000)
    shown = [name for name in MEASURES if name in state.columns]
    return state.select(
        "device_id",
        "ts",
        *[F.when(stale, F.lit(0.0)).otherwise(F.col(name)).alias(name) for name in shown],
        F.when(stale, F.lit("offline")).otherwise(F.lit("online")).alias("status"),
    )


def _settled(readings: DataFrame) -> DataFrame:
    """One score per member: a later reading of the same millisecond replaces it.

    Members are told apart by numbers, so the aggregation is hash-based with partial
    results before the shuffle; the id's text is made of the settled ones.
    """
    present = readings.filter(F.col("temperature").isNotNull())
    settled = present.groupBy("device_id", F.unix_millis("ts").alias("ms")).agg(
        F.max_by("temperature", "seq").alias("temperature")
    )
    return settled.select("device_id", text.ranking_member(F.col("ms")).alias("id"), "temperature")


def temperature_ranking(readings: DataFrame, limit: int = C.RANKING_LIMIT) -> DataFrame:
    """Hottest readings; of equal temperatures the larger id text comes first.

    A member's score can be replaced by a lower one, so all members are settled
    before the hottest are taken: one scan, one evenly spread shuffle, no sort.
    """
    rank = F.struct("temperature", "id", "device_id")
    return _settled(readings).orderBy(rank.desc()).limit(_at_least_one(limit))


def device_temperature_ranking(readings: DataFrame, limit: int = C.RANKING_LIMIT) -> DataFrame:
    """The hottest readings of each device.

    Members are settled by device and id, which spreads a hot device; each
    device is cut to ``limit`` rows before the second shuffle.
    """
    hottest = Window.partitionBy("device_id").orderBy(F.desc("temperature"), F.desc("id"))
    ranked = _settled(readings).withColumn("position", F.row_number().over(hottest))
    return ranked.filter(F.col("position") <= _at_least_one(limit))
