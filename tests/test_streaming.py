"""Streams give what batches give, wherever the micro-batches end."""

import glob
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrolens import schemas
from hydrolens.operators import alerts, control, latest, rollup, smoothing
from hydrolens.operators.quality import without_outliers
from hydrolens.sources.readings import stream_table
from hydrolens.streaming import kpis, sinks, state
from tests.helpers import at, rows

READINGS = schemas.READINGS
DAY = 86_400


def readings_data(n=240, seed=5):
    rng = random.Random(seed)
    clock, data = 0.0, []
    for seq in range(n):
        clock += rng.choice([1.0, 5.0, 5.0, 31.0, 120.0])
        device = 7 if rng.random() < 0.6 else rng.randrange(3)
        ph = rng.choice([None, 5.0, 6.0, 6.5, 9.0])
        ec = rng.choice([100.0, 200.0, 309.99, 900.0])
        data.append(
            (device, seq, at(clock), "http", rng.uniform(-15, 65), 50.0, 3.0,
             rng.choice([None, 4.0, 5.0]), ec, 7.0, ph)
        )
    return data


def files(spark, data, schema, folder, parts):
    """Writes rows to files which arrive one after the other."""
    size = -(-len(data) // parts)
    for number in range(parts):
        part = spark.createDataFrame(data[number * size : (number + 1) * size], schema)
        out = os.path.join(folder, f"part{number}")
        part.coalesce(1).write.parquet(out)
        for name in os.listdir(out):
            os.utime(os.path.join(out, name), (1_700_000_000 + number, 1_700_000_000 + number))
    return os.path.join(folder, "part*")


@pytest.fixture(params=[1, 5])
def source(spark, tmp_path, request):
    data = readings_data()
    path = files(spark, data, READINGS, str(tmp_path), request.param)
    return spark.createDataFrame(data, READINGS), stream_table(spark, path, READINGS, 1)


def test_moving_mean(spark, source):
    batch, stream = source
    expected = smoothing.moving_mean(batch, {"ph": "mean"}).select("seq", F.round("mean", 9))
    found = sinks.run_to_table(state.moving_mean(stream, {"ph": "mean"}), "t")
    assert rows(found.select("seq", F.round("mean", 9))) == rows(expected)


def test_smoothed_readings_keep_their_other_columns(spark, source):
    batch, stream = source
    expected = smoothing.smooth_ingest(batch, digits=None)
    names = ["seq", "temperature", "water_level", F.round("conductivity", 9), F.round("ph", 9)]
    found = sinks.run_to_table(state.smooth_ingest(stream, digits=None), "t")
    assert found.columns == expected.columns
    assert rows(found.select(*names)) == rows(expected.select(*names))


def test_hourly_indicators_in_update_mode(spark, source):
    batch, stream = source
    names = ["window_start", "max_temp", "min_temp", F.round("avg_temp", 6), F.round("stddev_temp", 6)]
    expected = rollup.aggregate_windows(without_outliers(batch)).select(*names)
    table = sinks.run_to_upserted(kpis.hourly_kpis(stream), "t", ["window_start", "window_end"])
    assert rows(table.select(*names)) == rows(expected)


def test_append_mode_gives_closed_hours_once(spark, source):
    batch, stream = source
    found = sinks.run_to_table(kpis.hourly_kpis(stream, "10 minutes"), "t")
    every = rollup.aggregate_windows(without_outliers(batch))
    newest = without_outliers(batch).agg(F.max("ts")).first()[0]
    closed = every.filter(F.col("window_end") <= F.lit(newest) - F.expr("interval 10 minutes"))
    assert closed.count() > 0
    assert rows(found, "window_start", "max_temp") == rows(closed, "window_start", "max_temp")


def test_alerts(spark, source):
    batch, stream = source
    assert rows(sinks.run_to_table(alerts.alerts(stream), "t")) == rows(alerts.alerts(batch))


def test_latest_state(spark, source):
    batch, stream = source
    fields = ("device_id", "ts", "temperature", "water_level", "ph")
    found = sinks.run_to_latest(stream, "t")
    assert rows(found, *fields) == rows(latest.latest_state(batch), *fields)


def test_offline_spans(spark, source):
    batch, stream = source
    newest = batch.agg(F.max("ts")).first()[0]
    expected = alerts.offline_spans(batch, newest, 30)
    found = state.settled_spans(sinks.run_to_table(state.offline_spans(stream, 30), "t"))
    assert rows(expected.filter("offline_until is null")) != []
    assert rows(found, *expected.columns) == rows(expected)


def test_pump_actions(spark, source):
    batch, stream = source
    is_write = F.col("seq") % 17 == 0

    def writes(df):
        flags = [((F.col("seq") / 17) % n > 0).cast("int").alias(name) for n, name in
                 ((2, "circ"), (3, "auto"), (5, "circ_auto"))]
        return df.filter(is_write).select(
            "device_id", "seq", "ts", F.lit(0).alias("nutri"), *flags
        )

    read = batch.filter(~is_write)
    smooth = smoothing.moving_mean(read, {"conductivity": "conductivity"}, digits=2)
    expected = control.actions(smooth, writes(batch))
    assert expected.select("action").distinct().count() == 4
    found = sinks.run_to_table(state.pump_actions(stream.filter(~is_write), writes(stream)), "t")
    assert rows(found, *expected.columns) == rows(expected)


def test_rows_without_a_device_leave_the_others_alone(spark, tmp_path):
    """They are a device of their own, also where ids are larger than floats hold."""
    big = 2**53 + 1
    data = [(None if row[1] % 4 == 0 else big + row[0], *row[1:]) for row in readings_data(120)]
    stream = stream_table(spark, files(spark, data, READINGS, str(tmp_path), 3), READINGS, 1)
    batch = spark.createDataFrame(data, READINGS)
    expected = smoothing.moving_mean(batch, {"ph": "mean"}).select("device_id", "seq", F.round("mean", 9))
    for delay in (None, "0 seconds"):
        found = sinks.run_to_table(state.moving_mean(stream, {"ph": "mean"}, delay=delay, width="1 second"), "t")
        # With a delay the newest rows are still held.
        known = expected.join(found.select("seq"), "seq", "left_semi").select(*expected.columns)
        assert rows(found.select("device_id", "seq", F.round("mean", 9))) == rows(known)
        assert found.count() >= (120 if delay is None else 100)
    spans = state.settled_spans(sinks.run_to_table(state.offline_spans(stream, 30), "t"))
    assert rows(spans) == rows(alerts.offline_spans(batch, batch.agg(F.max("ts")).first()[0], 30))


def long_data(n=1500, seed=3):
    """300 days; a third of the rows come from one device."""
    rng = random.Random(seed)
    data = []
    for seq in range(n):
        device = 7 if rng.random() < 0.35 else rng.randrange(20)
        ec = rng.choice([100.0, 200.0, 309.99, 900.0])
        clock = rng.uniform(0, 300 * DAY)
        data.append((device, seq, at(clock), "http", 20.0, 50.0, 3.0, 4.0, ec, 7.0, rng.choice([None, 5.0, 6.5])))
    return sorted(data, key=lambda row: row[2])


def shuffled(data, late_days, seed=4):
    """Rows in an order of arrival up to some days behind their time, and a closing row."""
    rng = random.Random(seed)
    order = sorted(data, key=lambda row: row[2].timestamp() + rng.uniform(0, late_days * DAY))
    closing = (None, 10**6, at(400 * DAY), *[None] * 8)
    return order, closing


def split(spark, path, data, closing, parts):
    """Files in this order, the closing row in one of its own."""
    paths = files(spark, data, READINGS, f"{path}/a", parts)
    end = files(spark, [closing], READINGS, f"{path}/b", 1)
    for name in glob.glob(end + "/*"):
        os.utime(name, (1_800_000_000, 1_800_000_000))
    return stream_table(spark, f"{path}/*/{os.path.basename(paths)}", READINGS, 1)


@pytest.mark.parametrize("parts", [1, 6])
def test_means_in_the_order_of_time(spark, tmp_path, parts):
    data = long_data()
    order, closing = shuffled(data, 20)
    stream = split(spark, tmp_path, order, closing, parts)
    found = sinks.run_to_table(state.moving_mean(stream, {"ph": "mean"}, delay="21 days", width="7 days"), "t")
    expected = smoothing.moving_mean(spark.createDataFrame(data, READINGS), {"ph": "mean"})
    assert found.filter("late").count() == 0
    assert rows(found.filter("seq < 1e6").select("seq", F.round("mean", 9))) == rows(expected.select("seq", F.round("mean", 9)))


def test_rows_beyond_the_delay_are_told_of(spark, tmp_path):
    """Rows of a bucket that was given on come as late, unsmoothed; the others are exact."""
    data = long_data()
    order, closing = shuffled(data, 5)
    behind = [row for row in order[:300] if row[1] % 50 == 0]
    order = [row for row in order if row not in behind] + behind
    stream = split(spark, tmp_path, order, closing, 6)
    found = sinks.run_to_table(state.moving_mean(stream, {"ph": "mean"}, delay="6 days", width="1 day"), "t").filter("seq < 1e6")
    late = rows(found.filter("late"), "seq", "ph", "mean")
    assert late == sorted([(row[1], row[10], None) for row in behind], key=repr) and late
    rest = spark.createDataFrame([row for row in data if row not in behind], READINGS)
    expected = smoothing.moving_mean(rest, {"ph": "mean"}).select("seq", F.round("mean", 9))
    assert rows(found.filter("not late").select("seq", F.round("mean", 9))) == rows(expected)


@pytest.mark.parametrize(("parts", "others"), [(5, 2), (1, 7)])
def test_actions_do_not_depend_on_the_files_of_two_inputs(spark, tmp_path, parts, others):
    data = long_data()
    is_write = lambda row: row[1] % 9 == 0
    rules = control.Rules(cooldown=6 * 3600, dose_for=3600, cycle_every=43200, cycle_for=18000)
    ends = []
    for name, keep, number in (("r", lambda row: not is_write(row), parts), ("w", is_write, others)):
        order, closing = shuffled([row for row in data if keep(row)], 10, number)
        ends.append(split(spark, tmp_path / name, order, closing, number))

    def writes(df):
        flags = [(F.col("seq") / 9 % n > 0).cast("int").alias(name) for n, name in ((2, "circ"), (3, "auto"), (5, "circ_auto"))]
        return df.select("device_id", "seq", "ts", F.lit(0).alias("nutri"), *flags)

    batch = spark.createDataFrame(data, READINGS)
    smooth = smoothing.moving_mean(batch.filter("seq % 9 <> 0"), {"conductivity": "conductivity"}, digits=2)
    expected = control.actions(smooth, writes(batch.filter("seq % 9 = 0")), rules)
    done = state.pump_actions(ends[0], writes(ends[1]), rules, delay="11 days", width="5 days")
    found = sinks.run_to_table(done, "t").filter("seq < 1e6")
    assert rows(found, *expected.columns) == rows(expected)


def test_a_bucket_is_given_on_with_the_watermark(spark, tmp_path):
    """What is held is given on bucket by bucket while the stream goes on."""
    step = state.MovingMean({"ph": "mean"}, 10, True)
    fed, feed = [], step.feed
    processor = state.InOrder(step, "1 second")

    class Store(dict):
        getValue, containsKey, removeKey = dict.get, dict.__contains__, dict.pop
        updateValue, keys = dict.__setitem__, lambda self: list(dict.keys(self))
        exists = lambda self: "v" in self
        get, update = lambda self: dict.__getitem__(self, "v"), lambda self, v: self.__setitem__("v", v)

    class Handle:
        timers: list = []
        getMapState = getValueState = lambda self, *a: Store()
        registerTimer = timers.append

    Store.getValue = lambda self, key: dict.get(self, key)
    handle = Handle()
    processor.init(handle)
    step.feed = lambda key, rows: fed.append(rows["seq"].tolist()) or feed(key, rows)
    frame = pd.DataFrame({"seq": [3, 1, 2], "ts": pd.to_datetime([3.5, 1.2, 1.1], unit="s"), "at": [3_500_000, 1_200_000, 1_100_000], "ph": [1.0, 2.0, 3.0]})
    assert list(processor.handleInputRows(("1",), iter([frame, frame.iloc[:1]]), None)) == []
    assert sorted(handle.timers) == [2000, 4000]

    class Expired:
        getExpiryTimeInMs = lambda self: 2000

    assert [out["mean"].tolist() for out in processor.handleExpiredTimer(("1",), None, Expired())] == [[3.0, 2.5]]
    assert fed == [[2, 1]] and list(processor.held.keys()) == [(3, 0), (3, 1)]
    (late,) = processor.handleInputRows(("1",), iter([frame]), None)
    assert sorted(late["seq"]) == [1, 2] and late["late"].all()


@pytest.mark.parametrize("bound", [310.0, 309.99])
def test_rounded_comparison(bound):
    values = np.array([309.985, 309.984999, 309.995, 309.99499, 310.0, 305.0, 315.0, np.nan, 309.99])
    assert state.is_below(values, bound, 2).tolist() == [state.half_up(v, 2) < bound for v in values.tolist()]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    data = readings_data(60)
    folder, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    for half in (0, 1):
        part = data[half * 30 : half * 30 + 30]
        files(spark, part, READINGS, os.path.join(folder, f"h{half}"), 1)
        stream = stream_table(spark, os.path.join(folder, "*", "part*"), READINGS, 1)
        means = state.moving_mean(stream, {"conductivity": "mean"})
        sinks.append_stream(means, out, progress).awaitTermination()
    batch = spark.createDataFrame(data, READINGS)
    expected = smoothing.moving_mean(batch, {"conductivity": "mean"})
    found = spark.read.parquet(out)
    assert rows(found.select("seq", F.round("mean", 9))) == rows(
        expected.select("seq", F.round("mean", 9))
    )
