"""Devices that are taken in groups: calls and state of a group, results of each device."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrolens.operators import control, smoothing
from hydrolens.sources.readings import stream_table
from hydrolens.streaming import sinks, state
from tests.helpers import at, rows
from tests.test_streaming import READINGS, files

DEVICES = 400


@pytest.fixture()
def many(spark, tmp_path):
    """Three readings of each of many devices, in two files, and one that closes the rest."""
    data = [(i % DEVICES or None, i, at(i * 60), "http", 20.0, 50.0, 3.0, 4.0, 100.0 + i % 7 * 50, 7.0, 5.0 + i % 3) for i in range(3 * DEVICES)]
    closing = (None, 10**6, at(10**7), *[None] * 8)
    stream = stream_table(spark, files(spark, [*data, closing], READINGS, str(tmp_path), 2), READINGS, 1)
    return spark.createDataFrame(data, READINGS), stream


def run(df, tmp_path):
    """Rows of the table, and the most entries the state had."""
    query = sinks.append_stream(df, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    entries = max(op["numRowsTotal"] for one in query.recentProgress for op in one["stateOperators"])
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out")), entries


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_a_mean_keeps_few_entries_for_many_devices(spark, many, tmp_path, delay):
    batch, stream = many
    means = state.moving_mean(stream, {"ph": "mean"}, delay=delay, width="1 day", groups=4)
    found, entries = run(means, tmp_path)
    expected = smoothing.moving_mean(batch, {"ph": "mean"}).select("device_id", "seq", F.round("mean", 9))
    assert rows(found.filter("seq < 1e6").select("device_id", "seq", F.round("mean", 9))) == rows(expected)
    assert entries < DEVICES / 4


def test_actions_keep_few_entries_for_many_devices(spark, many, tmp_path):
    batch, stream = many
    flags = [F.lit(n).alias(name) for n, name in ((0, "circ"), (1, "auto"), (1, "circ_auto"))]

    def split(df):
        writes = df.filter(f"seq < {DEVICES} OR seq = 1000000").select("device_id", "seq", "ts", F.lit(0).alias("nutri"), *flags)
        return df.filter(f"seq >= {DEVICES}"), writes

    done = state.pump_actions(*split(stream), delay="1 hour", width="1 day", groups=4)
    found, entries = run(done, tmp_path)
    read, writes = split(batch)
    smooth = smoothing.moving_mean(read, {"conductivity": "conductivity"}, digits=2)
    expected = control.actions(smooth, writes)
    assert found.select("action").distinct().count() > 1
    named = "device_id IS NOT NULL"
    assert rows(found.filter(named), *expected.columns) == rows(expected.filter(named))
    assert entries < DEVICES / 4


class Store(dict):
    containsKey, removeKey = dict.__contains__, dict.pop
    updateValue = dict.__setitem__

    def getValue(self, key):
        return dict.get(self, key)

    def keys(self):
        return list(dict.keys(self))

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class Handle:
    def getMapState(self, *a):
        return Store()

    def getValueState(self, *a):
        return Store()

    def registerTimer(self, at):
        pass


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_a_row_is_late_for_its_own_device_only():
    """A device that has given nothing on yet may still send rows of a bucket others gave on."""
    processor = state.InOrder(state.MovingMean({"ph": "mean"}, 10, True), "1 second")
    processor.init(Handle())

    def frame(*sent):
        made = pd.DataFrame(sent, columns=[state.DEVICE, "seq", "at", "ph"])
        return made.assign(ts=pd.to_datetime(made["at"], unit="us"))

    assert list(processor.handleInputRows((0,), iter([frame(("7", 1, 1_100_000, 2.0), ("8", 2, 2_100_000, 3.0))]), None)) == []
    (first,) = processor.handleExpiredTimer((0,), None, Expired(2000))
    assert first[["device_id", "seq", "mean"]].values.tolist() == [[7, 1, 2.0]]
    sent = frame(("7", 3, 1_200_000, 9.0), ("8", 4, 1_200_000, 5.0), ("", 5, 1_300_000, 6.0))
    (late,) = processor.handleInputRows((0,), iter([sent]), None)
    assert late[["device_id", "seq"]].values.tolist() == [[7, 3]] and late["late"].all()
    given = pd.concat(processor.handleExpiredTimer((0,), None, Expired(3000))).rename(columns={"mean": "mean_"})
    assert [(row.seq, row.mean_) for row in given.itertuples()] == [(4, 5.0), (5, 6.0), (2, 4.0)]
    assert given["device_id"].isna().tolist() == [False, True, False]
