"""Conversions: golden values, inverses and clamps."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydrolens.functions import units
from hydrolens.sources import readings as source
from tests.helpers import at


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "distance, litres", [(0, 10.0), (2, 10.0), (12, 5.0), (22, 0.0), (24, 0.0), (13.33, 4.34)]
)
def test_water_level(spark, distance, litres):
    found = value(spark, units.water_level(F.lit(float(distance))))
    assert found == pytest.approx(litres, abs=0.005)


def test_absent_distance_has_no_level(spark):
    assert value(spark, units.water_level(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("reading, ph", [(2.5, 2.5), (4.3, 8.00008)])
def test_serial_line(spark, reading, ph):
    assert value(spark, units.serial_ph(F.lit(reading))) == pytest.approx(ph, abs=1e-9)


@pytest.mark.parametrize("volts, ph", [(1.55, 8.0), (1.69, 2.5)])
def test_ingest_line(spark, volts, ph):
    assert value(spark, units.ingest_ph(F.lit(volts))) == pytest.approx(ph, abs=0.1)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(-5, 20), min_size=50, max_size=50))
def test_ph_and_volts_are_inverse(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "ph double")
    back = units.volts_to_ph(units.ph_to_volts(F.col("ph"))).alias("back")
    for row in df.select("ph", back).collect():
        assert math.isclose(row["ph"], row["back"], abs_tol=1e-9)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=50, max_size=50))
def test_level_stays_in_the_tank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "d double")
    for row in df.select(units.water_level(F.col("d")).alias("x")).collect():
        assert 0 <= row["x"] <= 10


@pytest.mark.parametrize("micros, cm", [(100, 1), (117, 1), (118, 2), (1585, 26)])
def test_echo_is_cut_off(spark, micros, cm):
    assert value(spark, units.echo_to_cm(F.lit(micros))) == cm


def test_conductivity_is_rounded_before_smoothing(spark):
    assert value(spark, units.ppm_to_conductivity(F.lit(100.003))) == 200.01
    assert value(spark, units.ppm_to_conductivity(F.lit(100.003), None)) == pytest.approx(200.006)


def test_dose_takes_five_seconds():
    assert units.dose_seconds() == 5.0


def test_a_failed_climate_sensor_reads_zero_on_both(spark):
    nan = float("nan")
    adc = spark.createDataFrame(
        [(1, 1, at(0), 0, 4095, 588, 21.0, nan), (1, 2, at(1), 0, 0, 0, 21.0, 55.0)],
        "device_id bigint, seq bigint, ts timestamp, tds_adc int, ph_adc int, echo_us bigint, "
        "temperature double, humidity double",
    )
    first, second = source.decode_adc(adc).orderBy("seq").collect()
    assert (first["temperature"], first["humidity"], first["distance"]) == (0.0, 0.0, 9)
    assert (second["temperature"], second["humidity"], second["tds_ppm"]) == (21.0, 55.0, 0.0)
    assert first["ph"] == pytest.approx(7 + (2.5 - 3.3) / 0.18)
