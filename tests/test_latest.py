"""Latest state, history, ranking, alerts and the report."""

import json

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import alerts, latest, report
from tests.helpers import at, rows

SCHEMA = (
    "device_id bigint, seq bigint, ts timestamp, temperature double, ph double, "
    "conductivity double, water_level double"
)


def table(spark, *data):
    return spark.createDataFrame([(1, i, at(i), *row) for i, row in enumerate(data)], SCHEMA)


def test_state_merges_field_by_field(spark):
    df = table(spark, (20.0, 7.0, 1.0, 4.0), (21.0, None, 2.0, None), (None, None, None, None))
    found = rows(latest.latest_state(df), "temperature", "ph", "conductivity", "water_level")
    assert found == [(21.0, 7.0, 2.0, 4.0)]


def test_status_of_nothing(spark):
    state = latest.latest_state(table(spark, (1.0, 1.0, 1.0, 1.0)).limit(0))
    assert latest.device_status(state, at(0)).count() == 0


def test_ties_go_to_the_larger_id_text(spark):
    df = spark.createDataFrame(
        [(1, i, at(10.0**i), 20.0) for i in range(3)],
        "device_id bigint, seq bigint, ts timestamp, temperature double",
    )
    ids = [row["id"] for row in latest.temperature_ranking(df, 2).collect()]
    every = sorted((row["id"] for row in latest.temperature_ranking(df, 9).collect()), reverse=True)
    assert len(every) == 3 and ids == every[:2]


@pytest.mark.parametrize("limit", [1, 3, 10, 40])
def test_a_replaced_score_does_not_rank(spark, limit):
    """Many of the hottest rows are replaced by cooler ones of the same millisecond."""
    data = []
    for i in range(200):
        data.append((i % 3, 2 * i, at(i // 3), float(i)))
        if i > 20:
            data.append((i % 3, 2 * i + 1, at(i // 3), float(i % 13)))
    df = spark.createDataFrame(
        data, "device_id bigint, seq bigint, ts timestamp, temperature double"
    )
    final = {}
    for device, _, ts, temperature in sorted(data, key=lambda row: row[1]):
        final[(device, f"reading:{int(ts.timestamp() * 1000)}")] = temperature
    expected = sorted(((t, i, d) for (d, i), t in final.items()), reverse=True)[:limit]
    found = latest.temperature_ranking(df, limit).select("temperature", "id", "device_id").collect()
    assert [tuple(row) for row in found] == expected


@pytest.mark.parametrize(
    "call", [latest.latest_n, latest.temperature_ranking, latest.device_temperature_ranking, latest.history_n]
)
def test_a_limit_is_at_least_one(spark, call):
    with pytest.raises(ValueError):
        call(table(spark, (1.0, 1.0, 1.0, 1.0)), 0)


def test_history_is_newest_first(spark):
    df = table(spark, *[(float(i), 7.0, 1.0, 1.0) for i in range(5)])
    found = rows(latest.history_n(df, 2), "position", "id", "temperature")
    assert found == [(1, "1735689604000-4", 4.0), (2, "1735689603000-3", 3.0)]
    assert [row["seq"] for row in latest.latest_n(df, 3).collect()] == [4, 3, 2]


@pytest.mark.parametrize(
    "temperature, ph, raised",
    [
        (20.0, 5.8, 0), (20.0, 6.8, 0), (20.0, 5.79, 1), (20.0, 6.81, 1), (20.0, None, 0),
        (None, 3.0, 0),
    ],
)
def test_alert_band(spark, temperature, ph, raised):
    assert alerts.alerts(table(spark, (temperature, ph, 1.0, 1.0))).count() == raised


def test_alert_text(spark):
    (row,) = alerts.alert_json(alerts.alerts(table(spark, (20.0, 4.5, 1.0, 1.0)))).collect()
    assert json.loads(row["value"]) == {
        "type": "CRITICAL", "message": "pH fora da faixa ideal: 4.5", "timestamp": 1735689600000,
    }


def test_report_lines(spark):
    df = table(spark, (20.0, 7.0, 900.5, 4.0), (21.0, None, 2.0, 5.25))
    (row,) = report.context_report(df, 10).collect()
    assert row["history"].split("\n") == [
        "T=21.00C, pH=None, EC=2.00, Nível=5.25L", "T=20.00C, pH=7.00, EC=900.50, Nível=4.00L",
    ]


def test_report_keeps_the_newest_rows(spark):
    df = table(spark, *[(float(i), 7.0, 1.0, 1.0) for i in range(30)])
    (row,) = report.context_report(df.withColumn("seq", F.col("seq")), 10).collect()
    lines = row["history"].split("\n")
    assert len(lines) == 10 and lines[0].startswith("T=29.00C") and lines[-1].startswith("T=20.00C")
