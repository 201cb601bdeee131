"""Hourly indicators of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hydrolens.operators.quality import without_outliers
from hydrolens.operators.rollup import aggregate_windows


def hourly_kpis(
    readings: DataFrame,
    delay: str | None = None,
    by: tuple[str, ...] = (),
    width: str = "1 hour",
) -> DataFrame:
    """Indicators per window of the readings so far.

    In update mode a window comes again when it changes. Without a ``delay`` readings
    count however late they come, and the state keeps one row per window (and key): some
    nine thousand a year. With one, a window is closed that long after it, in append
    mode it comes then, once, and later readings are dropped; a query's progress counts
    them as ``numRowsDroppedByWatermark``.
    """
    clean = without_outliers(readings)
    return aggregate_windows(clean if delay is None else clean.withWatermark("ts", delay), by, width)
