"""Calibration points, lines and calibrated readings."""

import random

import pytest

from hydrolens.operators import calibration
from hydrolens.operators.slicing import hot_cuts
from tests.helpers import at, rows

LOG = "device_id bigint, seq bigint, ts timestamp, op string, voltage double, ph double"
READINGS = "device_id bigint, seq bigint, ts timestamp, raw_ph double, ph double"


def log(spark, *entries):
    data = [(1, i, at(i), *entry) for i, entry in enumerate(entries)]
    return spark.createDataFrame(data, LOG)


def readings(spark, *values, start=100):
    data = [(1, start + i, at(start + i), value, value) for i, value in enumerate(values)]
    return spark.createDataFrame(data, READINGS)


def calibrate(spark, entries, raw_ph):
    df = log(spark, *entries)
    now = calibration.apply_current(readings(spark, raw_ph), calibration.live_points(df))
    then = calibration.apply_as_of(readings(spark, raw_ph), df)
    found = {row["calibrated_ph"] for one in (now, then) for row in one.collect()}
    assert len(found) == 1
    return found.pop()


def test_no_point_leaves_the_reading(spark):
    assert calibrate(spark, [], 6.123) == 6.123
    assert calibrate(spark, [("add", 2.5, 7.0), ("reset", None, None)], 6.123) == 6.123


def test_one_point_uses_the_standard_slope(spark):
    # 7.0 is 2.5 V, so the point itself is met; one unit lower is 0.18 V higher.
    assert calibrate(spark, [("add", 2.5, 6.5)], 7.0) == 6.5
    assert calibrate(spark, [("add", 2.5, 6.5)], 6.0) == round(6.5 - 5.5555 * 0.18, 2)


def test_two_points_make_a_line(spark):
    points = [("add", 2.5, 7.0), ("add", 3.0, 4.0)]
    assert calibrate(spark, points, 7.0) == 7.0
    assert calibrate(spark, points, 7.0 - 0.25 / 0.18) == 5.5


def test_only_the_outermost_points_count(spark):
    points = [("add", 2.5, 7.0), ("add", 2.7, 99.0), ("add", 3.0, 4.0)]
    assert calibrate(spark, points, 7.0 - 0.25 / 0.18) == 5.5


def test_a_voltage_given_again_replaces_its_ph(spark):
    points = [("add", 2.5, 1.0), ("add", 3.0, 4.0), ("add", 2.5, 7.0)]
    assert calibrate(spark, points, 7.0) == 7.0


def test_unreadable_points_are_skipped(spark):
    points = [("add", 2.5, None), ("add", None, 5.0), ("add", 2.5, 6.5)]
    assert calibrate(spark, points, 7.0) == 6.5


@pytest.mark.parametrize("count, calibrated", [(1, False), (2, True), (3, True)])
def test_two_points_calibrate(spark, count, calibrated):
    points = calibration.live_points(log(spark, *[("add", 2.0 + i, 7.0) for i in range(count)]))
    assert rows(calibration.status(points)) == [(1, count, calibrated)]
    assert calibration.report(points).count() == count


def test_requests_read_the_latest_state(spark):
    known = spark.createDataFrame(
        [(1, 10, at(10), 6.0, 9.0), (1, 20, at(20), None, 8.0), (2, 30, at(30), None, 5.0),
         (3, 31, at(31), None, None)],
        READINGS,
    )
    asked = spark.createDataFrame(
        [(d, s, at(s), 7.0) for d, s in [(1, 5), (1, 15), (1, 25), (2, 35), (3, 36)]],
        "device_id bigint, seq bigint, ts timestamp, known_ph double",
    )
    found = rows(calibration.points_from_requests(asked, known), "seq", "voltage", "ph")
    volts = {s: pytest.approx(2.5 - (ph - 7) * 0.18) for s, ph in ((15, 6), (25, 6), (35, 5), (36, 0))}
    assert found == [(s, volts[s], 7.0) for s in sorted(volts)]


def random_log(spark, n=400, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        device = 7 if rng.random() < 0.7 else rng.randrange(3)
        if rng.random() < 0.03:
            data.append((device, i, at(i), "reset", None, None))
        else:
            data.append((device, i, at(i), "add", rng.randrange(20) / 10, float(rng.randrange(14))))
    return data


@pytest.mark.parametrize("rows_per_slice", [None, 4, 20, 100])
def test_line_history_equals_brute_force(spark, rows_per_slice):
    data = random_log(spark)
    expected, points = [], {}
    for device, seq, _, op, voltage, ph in data:
        if op == "reset":
            points[device] = {}
        else:
            points.setdefault(device, {})[voltage] = ph
        live = points[device]
        slope = None
        if len(live) == 1:
            slope = -5.5555
        elif live:
            low, high = min(live), max(live)
            slope = (live[high] - live[low]) / (high - low)
        expected.append((seq, slope))
    df = spark.createDataFrame(data, LOG)
    history = calibration.line_history(df, hot_cuts(df, rows_per_slice))
    found = rows(history.select("seq", "line.slope"))
    assert [seq for seq, _ in sorted(found)] == [seq for seq, _ in expected]
    for (_, slope), (_, wanted) in zip(sorted(found, key=lambda r: r[0]), expected):
        assert slope == (None if wanted is None else pytest.approx(wanted))
