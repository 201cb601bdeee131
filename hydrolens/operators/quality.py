"""Cleaning, outlier rules and advisory bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.functions import payload, text

MEASURES = ("temperature", "humidity", "ph", "conductivity", "distance")


def clean(log: DataFrame) -> DataFrame:
    """Log entries as typed readings; unreadable numbers become null.

    Entries without a readable time are dropped; :func:`untimed` gives them.
    """
    typed = log.select(
        "device_id",
        "seq",
        "stream_id",
        text.stream_id_millis(F.col("stream_id")).alias("arrival_ms"),
        payload.instant(payload.number(F.col("timestamp"))).alias("ts"),
        *[payload.number(F.col(name)).alias(name) for name in MEASURES],
    )
    return typed.filter(F.col("ts").isNotNull())


def untimed(log: DataFrame) -> DataFrame:
    """Log entries which :func:`clean` drops, with the reason."""
    read = payload.instant(payload.number(F.col("timestamp")))
    reason = F.when(F.col("timestamp").isNull(), "no time").otherwise("bad time")
    return log.withColumn("reason", reason).filter(read.isNull())


def plausible() -> Column:
    """pH within its closed range, temperature within its open one.

    Null for a reading which lacks either, false for NaN: both are dropped by a
    filter.
    """
    ph, temperature = F.col("ph"), F.col("temperature")
    return (
        (ph >= C.PH_MIN)
        & (ph <= C.PH_MAX)
        & (temperature > C.TEMPERATURE_ABOVE)
        & (temperature < C.TEMPERATURE_BELOW)
    )


def without_outliers(readings: DataFrame) -> DataFrame:
    return readings.filter(plausible())


def outlier_counts(readings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows before and after the filter in one pass, nulls and outliers apart."""
    lacking = F.col("ph").isNull() | F.col("temperature").isNull()
    kept = F.coalesce(plausible(), F.lit(False))
    return readings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(~kept).alias("outliers"),
        F.count_if(lacking).alias("rows_null"),
        F.count_if(~kept & ~lacking).alias("rows_out_of_range"),
    )


def range_status(
    readings: DataFrame, bands: dict[str, tuple[float | None, float | None]] | None = None
) -> DataFrame:
    """``<measure>_status``: low, ok or high against the advisory bands."""
    added = {}
    for name, (low, high) in (bands or C.IDEAL_BANDS).items():
        value = F.col(name)
        status = F.when(value.isNull(), F.lit(None).cast("string"))
        if low is not None:
            status = status.when(value < low, F.lit("low"))
        if high is not None:
            status = status.when(value > high, F.lit("high"))
        added[f"{name}_status"] = status.otherwise(F.lit("ok"))
    return readings.withColumns(added)
