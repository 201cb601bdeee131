"""Hourly indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions import text
from hydrolens.operators.quality import without_outliers


def aggregate_windows(
    readings: DataFrame, by: tuple[str, ...] = (), width: str = "1 hour"
) -> DataFrame:
    """Tumbling-window indicators; unordered, so it also runs on a stream."""
    kpis = readings.groupBy(*by, F.window("ts", width).alias("win")).agg(
        F.avg("temperature").alias("avg_temp"),
        F.max("temperature").alias("max_temp"),
        F.min("temperature").alias("min_temp"),
        F.avg("ph").alias("avg_ph"),
        F.avg("humidity").alias("avg_humidity"),
        F.stddev_samp("temperature").alias("stddev_temp"),
    )
    return kpis.select(
        *by,
        F.col("win.start").alias("window_start"),
        F.col("win.end").alias("window_end"),
        "avg_temp", "max_temp", "min_temp", "avg_ph", "avg_humidity", "stddev_temp",
    )


def hourly_kpis(
    readings: DataFrame,
    by: tuple[str, ...] = (),
    width: str = "1 hour",
    ordered: bool = True,
) -> DataFrame:
    """Outlier-free indicators per window; ``ordered`` sorts the whole result."""
    kpis = aggregate_windows(without_outliers(readings), by, width)
    return kpis.orderBy(*by, "window_start") if ordered else kpis


def partial_windows(
    readings: DataFrame, by: tuple[str, ...] = (), width: str = "1 hour"
) -> DataFrame:
    """What of each window's readings is enough to add others later: counts, means, the
    temperature's squared deviations from its mean, its extremes."""
    n, means = F.count, F.avg
    parts = without_outliers(readings).groupBy(*by, F.window("ts", width).alias("win")).agg(
        *[n(name).alias(f"n_{name}") for name in _MEANS],
        *[means(name).alias(f"mean_{name}") for name in _MEANS],
        (F.var_pop("temperature") * n("temperature")).alias("m2_temperature"),
        F.max("temperature").alias("max_temp"),
        F.min("temperature").alias("min_temp"),
    )
    ends = [F.col("win.start").alias("window_start"), F.col("win.end").alias("window_end")]
    return parts.select(*by, *ends, *[name for name in parts.columns if name not in (*by, "win")])


_MEANS = ("temperature", "ph", "humidity")


def merge_windows(partials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per window of any number of partial ones, in the same columns.

    Squared deviations are moved to the common mean before they are added, so nothing is
    lost where they are small beside it. The mean and the sums share one shuffle.
    """
    keys = [*by, "window_start", "window_end"]
    whole = Window.partitionBy(*keys)
    sums = {name: F.col(f"n_{name}") * F.col(f"mean_{name}") for name in _MEANS}
    common = {
        f"common_{name}": F.sum(total).over(whole) / F.nullif(F.sum(f"n_{name}").over(whole), F.lit(0))
        for name, total in sums.items()
    }
    placed = partials.withColumns(common)
    moved = F.col("n_temperature") * F.pow(F.col("mean_temperature") - F.col("common_temperature"), 2)
    return placed.groupBy(*keys).agg(
        *[F.sum(f"n_{name}").alias(f"n_{name}") for name in _MEANS],
        *[F.max(f"common_{name}").alias(f"mean_{name}") for name in _MEANS],
        F.sum(F.col("m2_temperature") + moved).alias("m2_temperature"),
        F.max("max_temp").alias("max_temp"),
        F.min("min_temp").alias("min_temp"),
    )


def settle_windows(merged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Indicators of merged windows, as :func:`aggregate_windows` gives them."""
    several = F.when(F.col("n_temperature") > 1, F.sqrt(F.col("m2_temperature") / (F.col("n_temperature") - 1)))
    return merged.select(
        *by, "window_start", "window_end", F.col("mean_temperature").alias("avg_temp"), "max_temp", "min_temp",
        F.col("mean_ph").alias("avg_ph"), F.col("mean_humidity").alias("avg_humidity"), several.alias("stddev_temp"),
    )


def keyed_kpis(kpis: DataFrame) -> DataFrame:
    """Indicators with their hour key; of equal keys the later window is kept.

    The hour key is in session time, so a repeated local hour would share a key.
    """
    names = kpis.columns
    keyed = kpis.withColumn("kpi_key", text.kpi_key(F.col("window_start")))
    by = [name for name in ("device_id",) if name in names]
    newest = keyed.groupBy(*by, "kpi_key").agg(
        F.max_by(F.struct(*names), "window_start").alias("kpi")
    )
    return newest.select("kpi_key", "kpi.*")
