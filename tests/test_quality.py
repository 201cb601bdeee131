"""Cleaning, outlier ranges, hourly indicators and bands."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import quality, rollup
from tests.helpers import START, at, rows, seconds

NAN = float("nan")
READING = (
    "device_id bigint, seq bigint, ts timestamp, temperature double, humidity double, ph double, "
    "conductivity double, water_level double"
)


def reading(spark, *pairs):
    data = [(1, i, at(i), t, 50.0, ph, 900.0, 5.0) for i, (t, ph) in enumerate(pairs)]
    return spark.createDataFrame(data, READING)


@pytest.mark.parametrize(
    "ph, kept",
    [(0.0, True), (14.0, True), (-0.01, False), (14.01, False), (None, False), (NAN, False)],
)
def test_ph_ends_belong(spark, ph, kept):
    assert quality.without_outliers(reading(spark, (20.0, ph))).count() == int(kept)


@pytest.mark.parametrize(
    "temperature, kept",
    [(-10.0, False), (60.0, False), (-9.99, True), (59.99, True), (None, False), (NAN, False)],
)
def test_temperature_ends_do_not(spark, temperature, kept):
    assert quality.without_outliers(reading(spark, (temperature, 7.0))).count() == int(kept)


def test_nulls_are_counted_apart(spark):
    df = reading(spark, (20.0, 7.0), (None, 7.0), (20.0, None), (99.0, 7.0), (20.0, NAN), (99.0, None))
    assert rows(quality.outlier_counts(df)) == [(6, 1, 5, 3, 2)]


def test_counts_of_nothing(spark):
    assert rows(quality.outlier_counts(reading(spark).limit(0))) == [(0, 0, 0, 0, 0)]


def log(spark, *entries):
    names = "seq bigint, temperature string, ph string, timestamp string"
    df = spark.createDataFrame([(i, *entry) for i, entry in enumerate(entries)], names)
    return df.select(
        F.lit(1).cast("bigint").alias("device_id"), "seq",
        F.concat(F.lit("1735689600123-"), F.col("seq")).alias("stream_id"),
        "temperature", F.lit("50").alias("humidity"), "ph", F.lit("x").alias("conductivity"),
        F.lit(None).cast("string").alias("distance"), "timestamp",
    )


def test_unreadable_text_becomes_null_and_no_time_drops(spark):
    df = quality.clean(
        log(spark, ("20.5", "bad", "1735689600123"), ("1", "7", None), ("1", "7", "soon"))
    )
    (row,) = df.collect()
    assert (row["temperature"], row["ph"], row["conductivity"]) == (20.5, None, None)
    assert seconds(row["ts"]) == 0.123 and row["arrival_ms"] == 1735689600123


def test_hour_key_of_epoch_milliseconds(spark):
    df = quality.clean(log(spark, ("20", "7", "1735689600123")))
    keyed = rollup.keyed_kpis(rollup.aggregate_windows(df)).first()
    assert keyed["kpi_key"] == "kpi:2025010100"
    assert seconds(keyed["window_start"]) == 0 and seconds(keyed["window_end"]) == 3600


def test_hours_are_half_open_and_ordered(spark):
    df = reading(spark, (20.0, 7.0), (22.0, 6.0)).withColumn(
        "ts", F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("seq") * 3600)
    )
    found = rollup.hourly_kpis(df).collect()
    assert [seconds(row["window_start"]) for row in found] == [0, 3600]
    assert [row["avg_temp"] for row in found] == [20.0, 22.0]
    assert all(row["stddev_temp"] is None for row in found)


def test_sample_deviation(spark):
    (row,) = rollup.hourly_kpis(reading(spark, (20.0, 7.0), (22.0, 6.0), (24.0, 5.0))).collect()
    assert (row["avg_temp"], row["min_temp"], row["max_temp"]) == (22.0, 20.0, 24.0)
    assert math.isclose(row["stddev_temp"], 2.0) and row["avg_ph"] == 6.0


def test_bands(spark):
    df = quality.range_status(reading(spark, (17.9, 6.6), (28.0, 5.5), (None, None)))
    assert rows(df, "seq", "temperature_status", "ph_status", "conductivity_status") == [
        (0, "low", "high", "ok"), (1, "ok", "ok", "ok"), (2, None, None, "ok"),
    ]


def test_result_does_not_depend_on_partitions(spark):
    pairs = [(float(i % 70 - 8), float(i % 15)) for i in range(300)]
    df = reading(spark, *pairs)
    whole = rollup.hourly_kpis(df.coalesce(1)).select("window_start", F.round("avg_temp", 9), "max_temp")
    for parts in (2, 8):
        split = rollup.hourly_kpis(df.repartition(parts, F.rand(parts)))
        assert rows(split.select("window_start", F.round("avg_temp", 9), "max_temp")) == rows(whole)


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("shift", [0.0, 40.0])
def test_partial_windows_merge_to_the_whole(spark, parts, shift):
    """Any split, merged in any order and again, gives the indicators of one pass; small
    deviations from a large mean are not lost."""
    rng = random.Random(parts)
    spread = 15.0 if shift == 0 else 1e-6
    data = [
        (rng.choice([1, None]), seq, at(rng.uniform(0, 4 * 3600)), shift + rng.uniform(0, spread), rng.choice([None, 40.0, 60.0]), 7.0, 900.0, 5.0)
        for seq in range(200)
    ]
    data += [(1, 999, at(9 * 3600), 20.0, 50.0, 7.0, 900.0, 5.0), (1, 1000, at(9 * 3600), 70.0, 50.0, 7.0, 900.0, 5.0)]
    readings = spark.createDataFrame(data, READING)
    for by in ((), ("device_id",)):
        expected = {row[: len(by) + 1]: row for row in rows(rollup.hourly_kpis(readings, by, ordered=False))}
        merged = None
        for part in range(parts):
            own = rollup.partial_windows(readings.filter(F.col("seq") % parts == part), by)
            merged = rollup.merge_windows(own if merged is None else merged.unionByName(own), by)
        found = rows(rollup.settle_windows(merged, by))
        assert len(found) == len(expected)
        for row in found:
            for value, wanted in zip(row, expected[row[: len(by) + 1]]):
                assert value == wanted or value == pytest.approx(wanted, rel=1e-6)
