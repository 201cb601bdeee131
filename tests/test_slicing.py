"""Hot devices cut into slices give what one window per device gives."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import alerts, smoothing
from hydrolens.operators.asof import as_of, broadcast_as_of
from hydrolens.operators.slicing import hot_cuts, place
from tests.helpers import at, rows, seconds

SCHEMA = "device_id bigint, seq bigint, ts timestamp, ph double"


def skewed(spark, n=600, seed=1):
    """One device holds most rows, in bursts, with equal times among them."""
    rng = random.Random(seed)
    data, clock = [], 0
    for seq in range(n):
        clock += rng.choice([0, 0, 0, 1, 1, 5, 4000])
        device = 7 if rng.random() < 0.7 else rng.randrange(5)
        data.append((device, seq, at(clock), float(rng.randrange(1400)) / 100))
    return spark.createDataFrame(data, SCHEMA)


def test_no_cuts_without_hot_devices(spark):
    df = skewed(spark, 50)
    assert hot_cuts(df) is None
    assert hot_cuts(df.limit(0), 1) is None


def test_cuts_split_only_hot_devices_evenly(spark):
    df = skewed(spark)
    cuts = hot_cuts(df, 100)
    assert rows(cuts, "device_id") == [(7,)]
    placed = place(df, cuts)
    assert placed.count() == df.count()
    sizes = placed.groupBy("is_hot", "slice").count().collect()
    assert [row["slice"] for row in sizes if not row["is_hot"]] == [0]
    hot = [row["count"] for row in sizes if row["is_hot"]]
    assert len(hot) > 3 and max(hot) < 150


def test_slices_follow_time(spark):
    placed = place(skewed(spark), hot_cuts(skewed(spark), 60)).filter("is_hot")
    spans = placed.groupBy("slice").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    ordered = [(row["a"], row["b"]) for row in spans.orderBy("slice").collect()]
    assert all(before[1] < after[0] for before, after in zip(ordered, ordered[1:]))


def brute_means(data, length):
    found, past = [], {}
    for device, seq, _, value in sorted(data, key=lambda row: (row[0], row[2], row[1])):
        window = past.setdefault(device, [])
        window.append(value)
        del window[:-length]
        found.append((device, seq, round(sum(window) / len(window), 6)))
    return sorted(found)


# With slices of 3 rows several slices are shorter than the frame.
@pytest.mark.parametrize("rows_per_slice", [None, 3, 8, 50, 200])
def test_moving_mean_equals_brute_force(spark, rows_per_slice):
    df = skewed(spark)
    found = smoothing.moving_mean(df, {"ph": "mean"}, rows_per_slice=rows_per_slice)
    got = [(d, s, round(m, 6)) for d, s, m in rows(found, "device_id", "seq", "mean")]
    assert sorted(got) == brute_means([tuple(row) for row in df.collect()], 10)


def test_cuts_of_another_table_change_nothing(spark):
    df = skewed(spark)
    other = df.filter("seq > 300").withColumn("device_id", F.lit(7).cast("bigint"))
    means = {"ph": "mean"}
    found = smoothing.moving_mean(df, means, rows_per_slice=9, sized_by=other)
    assert rows(found, "seq", "mean") == rows(smoothing.moving_mean(df, means), "seq", "mean")


def test_mean_of_a_constant_is_the_constant(spark):
    df = skewed(spark).withColumn("ph", F.lit(6.5))
    found = smoothing.moving_mean(df, {"ph": "mean"}, rows_per_slice=20)
    assert rows(found.select("mean").distinct()) == [(6.5,)]


@pytest.mark.parametrize("rows_per_slice", [1, 10, 100])
def test_gaps_and_silences(spark, rows_per_slice):
    df = skewed(spark)
    plain, sliced = (smoothing.reading_gaps(df, rows_per_slice=n) for n in (None, rows_per_slice))
    assert rows(plain, "seq", "gap_us") == rows(sliced, "seq", "gap_us")
    now = at(10_000_000)
    plain, sliced = (alerts.offline_spans(df, now, 30, n) for n in (None, rows_per_slice))
    assert rows(plain) == rows(sliced)


def test_partitions_and_input_order_do_not_matter(spark):
    df = skewed(spark)
    expected = rows(smoothing.moving_mean(df, {"ph": "mean"}), "seq", "mean")
    shuffled = df.orderBy(F.rand(3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "2", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert rows(smoothing.moving_mean(shuffled, {"ph": "mean"}), "seq", "mean") == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    "look_up",
    [broadcast_as_of, *[partial(as_of, rows_per_slice=size) for size in (None, 1, 4, 20, 100)]],
)
def test_as_of_equals_brute_force(spark, look_up):
    """The rows without a device have a log of their own."""
    df = skewed(spark, 400)
    df = df.withColumn("device_id", F.when(F.col("seq") % 5 != 0, F.col("device_id")))
    readings = df.filter("seq % 7 != 0").select("device_id", "seq", "ts")
    log = df.filter("seq % 7 = 0").select(
        "device_id", "seq", "ts", "ph", F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("n")
    )
    entries = log.collect()
    expected = []
    for row in readings.collect():
        known = [e for e in entries if e["device_id"] == row["device_id"] and e["ts"] <= row["ts"]]
        known.sort(key=lambda e: (e["ts"], e["seq"]))
        ph = known[-1]["ph"] if known else None
        numbers = [e["n"] for e in known if e["n"] is not None]
        expected.append((row["seq"], ph, numbers[-1] if numbers else None))
    found = look_up(readings, log, ["ph", "n"])
    assert rows(found, "seq", "ph", "n") == sorted(expected, key=repr)


def test_staleness_bounds(spark):
    from hydrolens.operators import latest

    state = spark.createDataFrame(
        [(1, at(0), 7.0), (2, at(-0.001), 7.0)], "device_id bigint, ts timestamp, ph double"
    )
    found = rows(latest.device_status(state, at(30)), "device_id", "ph", "status")
    assert found == [(1, 7.0, "online"), (2, 0.0, "offline")]


def test_a_silence_is_longer_than_the_limit(spark):
    data = [(1, 1, at(0), 1.0), (1, 2, at(30), 1.0), (1, 3, at(60.001), 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    found = alerts.offline_spans(df, at(90.001)).collect()
    assert [(seconds(r["offline_from"]), seconds(r["offline_until"])) for r in found] == [(60, 60.001)]
    (open_span,) = alerts.offline_spans(df, at(91)).filter("offline_until is null").collect()
    assert seconds(open_span["offline_from"]) == 90.001
