"""Critical pH alerts and offline spans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.functions import text
from hydrolens.operators.slicing import over_rows


def critical_ph(low: float = C.ALERT_PH_LOW, high: float = C.ALERT_PH_HIGH) -> Column:
    ph = F.col("ph")
    return (ph < low) | (ph > high)


def alerts(
    readings: DataFrame,
    low: float = C.ALERT_PH_LOW,
    high: float = C.ALERT_PH_HIGH,
    digits: int | None = None,
) -> DataFrame:
    """One alert per reading out of the band; stateless, so it runs on streams too.

    A reading without pH or without temperature raises none.
    """
    raised = readings.filter(critical_ph(low, high) & F.col("temperature").isNotNull())
    return raised.select(
        "device_id",
        "seq",
        "ts",
        F.lit(C.ALERT_TYPE).alias("type"),
        text.alert_message(F.col("ph"), digits).alias("message"),
        F.unix_millis("ts").alias("timestamp"),
    )


def alert_json(raised: DataFrame) -> DataFrame:
    """Alerts as JSON texts, for a message sink."""
    body = F.to_json(F.struct("type", "message", "timestamp"))
    return raised.select("device_id", "ts", body.alias("value"))


def offline_spans(
    readings: DataFrame,
    now: datetime | None = None,
    offline_after: float = C.OFFLINE_AFTER_SECONDS,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """When each device was silent too long; an unfinished span has no end."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    limit = int(offline_after * 1_000_000)

    def add(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("next_ts", F.lag("ts").over(window))

    asked = readings.select("device_id", "seq", "ts")
    seen = over_rows(asked, add, 1, forward=True, rows_per_slice=rows_per_slice)
    until = F.unix_micros(F.coalesce("next_ts", clock))
    silent = seen.filter(until - F.unix_micros("ts") > limit)
    return silent.select(
        "device_id",
        F.timestamp_micros(F.unix_micros("ts") + limit).alias("offline_from"),
        F.col("next_ts").alias("offline_until"),
    )
