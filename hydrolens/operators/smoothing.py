"""Moving means over the last readings of a device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.operators.slicing import over_rows


def moving_mean(
    readings: DataFrame,
    columns: dict[str, str],
    length: int = C.SMOOTHING_ROWS,
    digits: int | None = None,
    rows_per_slice: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Mean of each column over the last ``length`` readings, this one included.

    ``columns`` maps a measure to the name of its mean. All means share one
    shuffle and sort.
    """

    def add(rows: DataFrame, window) -> DataFrame:
        frame = window.rowsBetween(1 - length, 0)
        means = {out: F.avg(name).over(frame) for name, out in columns.items()}
        if digits is not None:
            means = {out: F.round(mean, digits) for out, mean in means.items()}
        return rows.withColumns(means)

    return over_rows(
        readings, add, length - 1, rows_per_slice=rows_per_slice, sized_by=sized_by
    )


def smooth_ingest(
    http: DataFrame,
    digits: int | None = 2,
    rows_per_slice: int | None = None,
    raw: DataFrame | None = None,
) -> DataFrame:
    """Final form of a network reading: pH and conductivity smoothed.

    pH is smoothed unrounded, conductivity after its rounding to two decimals.
    The smoothed conductivity is also kept under its device name. With the
    ``raw`` payloads at hand, devices are counted there and not after parsing.
    """
    means = {"ph": "ph", "conductivity": "conductivity"}
    smoothed = moving_mean(
        http, means, digits=digits, rows_per_slice=rows_per_slice, sized_by=raw
    )
    return smoothed.withColumn("eletrocondutividade", F.col("conductivity"))


def reading_gaps(readings: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """Microseconds since the device's previous reading, null for its first."""

    def add(rows: DataFrame, window) -> DataFrame:
        before = F.lag("ts").over(window)
        gap = F.unix_micros("ts") - F.unix_micros(before)
        return rows.withColumns({"previous_ts": before, "gap_us": gap})

    asked = readings.select("device_id", "seq", "ts")
    return over_rows(asked, add, 1, rows_per_slice=rows_per_slice)
