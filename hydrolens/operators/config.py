"""Pump configuration: normalised writes, current flags, flags at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.operators.asof import as_of


def flag(name: str) -> Column:
    """A boolean or numeric flag as 0 or 1, 0 where it is absent."""
    return F.coalesce(F.col(name).cast("int"), F.lit(0)).alias(name)


def config_writes(writes: DataFrame) -> DataFrame:
    """Each write sets all four flags; those not given become 0."""
    given = [name if name in writes.columns else None for name in C.FLAGS]
    flags = [flag(name) if name else F.lit(0).alias(C.FLAGS[i]) for i, name in enumerate(given)]
    return writes.select("device_id", "seq", "ts", *flags)


def config_current(config_log: DataFrame) -> DataFrame:
    """The flags in force per device after all writes."""
    last = [F.max_by(name, "seq").alias(name) for name in C.FLAGS]
    return config_log.groupBy("device_id").agg(F.max_by("ts", "seq").alias("ts"), *last)


def config_as_of(
    readings: DataFrame,
    config_log: DataFrame,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Readings with the flags in force at their time, 0 before the first write."""
    joined = as_of(readings, config_log, C.FLAGS, rows_per_slice)
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in C.FLAGS})


def dose_candidates(
    readings: DataFrame,
    config_log: DataFrame,
    below: float = C.DOSE_BELOW_EC,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Readings with low conductivity while dosing automation is on."""
    joined = config_as_of(readings, config_log, rows_per_slice)
    return joined.filter((F.col("auto") == 1) & (F.col("conductivity") < below))
