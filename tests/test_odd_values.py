"""No value of an input ends a job."""

import pytest
from pyspark.sql import functions as F

from hydrolens import schemas
from hydrolens.functions import payload, text
from hydrolens.operators import alerts, quality, report
from hydrolens.sources import readings as source
from hydrolens.streaming import state
from tests.helpers import at, rows

NUMBERS = ["nan", "inf", "-inf", "1e30", "-1e30", "1e18", "1e308", "1e999", "soon", "", " ", "9" * 400, None]


def test_log_entries(spark):
    data = [(1, i, f"{i}-0", n, n, n, n, n, n) for i, n in enumerate(NUMBERS)]
    log = spark.createDataFrame(data, schemas.READING_LOG)
    assert quality.clean(log).count() == 0
    assert {r.reason for r in quality.untimed(log).collect()} == {"no time", "bad time"}
    assert quality.untimed(log).count() == len(NUMBERS)


def test_serial_lines(spark):
    lines = [f'{{"ph": {n!r}, "timestamp": 1}}'.replace("'", '"') for n in NUMBERS if n is not None]
    times = [f'{{"ph": 7, "timestamp": "{n}"}}' for n in NUMBERS if n is not None]
    data = [(1, i, at(i), line) for i, line in enumerate([*lines, *times])]
    raw = spark.createDataFrame(data, "device_id bigint, seq bigint, ts timestamp, payload string")
    taken, refused = source.serial_readings(raw), source.rejects(raw, "serial")
    assert taken.count() + refused.count() == len(data)
    assert {r.reason for r in refused.collect()} == {"bad number", "bad time"}
    assert alerts.alerts(taken.withColumn("temperature", F.lit(1.0))).filter("message is null").count() == 0


def test_messages_and_lines(spark):
    values = [float(n) for n in ("nan", "inf", "1e30", "1e308", "-1e30")] + [6.804]
    data = [(1, i, at(i), 20.0, v, v, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(
        data, "device_id bigint, seq bigint, ts timestamp, temperature double, ph double, conductivity double, water_level double"
    )
    raised = alerts.alerts(df).collect()
    assert all(r.message for r in raised) and raised[-1].message.endswith("6.804")
    assert report.context_report(df).first().history.count("\n") == len(values) - 1


def test_the_last_of_a_repeated_key_counts(spark):
    data = [(1, 1, at(0), '{"ph": 7, "temperature": 1, "ph": 9}'), (1, 2, at(0), '{"ph": 7, "pH": 8}')]
    raw = spark.createDataFrame(data, "device_id bigint, seq bigint, ts timestamp, payload string")
    found = payload.with_fields(raw, {"ph": ("pH", "ph")}).select("fields.ph.number")
    assert [r.number for r in found.collect()] == [9.0, 8.0]


def test_full_texts(spark):
    one = spark.range(1).select(text.fixed(F.lit(2.675), None).alias("a"), text.fixed(F.lit(2.0), 1).alias("b"))
    assert tuple(one.first()) == ("2.675", "2.0")


@pytest.mark.parametrize("value", [2.675, 310.125, 0.125, 2.5, -2.675, 1e15 + 0.3, float("inf")])
def test_streams_round_as_batches_do(spark, value):
    expected = spark.range(1).select(F.round(F.lit(value), 2)).first()[0]
    assert state.half_up(value, 2) == expected
