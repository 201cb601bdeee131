"""Tables: overwrite by date, append, upsert."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from hydrolens.operators.latest import latest_state
from hydrolens.session import fresh_dir, shared_dir, written
from hydrolens.streaming import sinks
from tests.helpers import at, rows

DAY = 86_400


def kpis(spark, *pairs):
    return spark.createDataFrame([(at(s), v) for s, v in pairs], "window_start timestamp, avg_temp double")


def test_overwrite_replaces_only_the_dates_given(spark, tmp_path):
    path = str(tmp_path / "kpis")
    sinks.overwrite_parquet(kpis(spark, (0, 1.0), (3600, 2.0), (DAY, 3.0)), path, "window_start")
    sinks.overwrite_parquet(kpis(spark, (DAY, 9.0)), path, "window_start")
    assert rows(spark.read.parquet(path), "avg_temp") == [(1.0,), (2.0,), (9.0,)]
    assert sorted(n for n in os.listdir(path) if n.startswith("date")) == [
        "date=2025-01-01", "date=2025-01-02",
    ]


def test_overwrite_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "kpis")
    sinks.overwrite_parquet(kpis(spark, (0, 1.0), (DAY, 3.0)), path)
    sinks.overwrite_parquet(kpis(spark, (DAY, 9.0)), path)
    assert rows(spark.read.parquet(path), "avg_temp") == [(9.0,)]


def test_append(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_parquet(kpis(spark, (0, 1.0)), path)
    sinks.append_parquet(kpis(spark, (1, 2.0)), path)
    assert rows(spark.read.parquet(path), "avg_temp") == [(1.0,), (2.0,)]


def test_upsert_keeps_the_last_row_per_key(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "k bigint, v string"
    for batch, data in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, None)], [(3, "d")]]):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/batch={batch}")
    spark.createDataFrame([(2, "c"), (3, "x")], schema).write.mode("overwrite").parquet(f"{path}/batch=1")
    table = sinks.read_upserted(spark, path, spark.createDataFrame([], schema).schema, ["k"])
    assert rows(table, "k", "v") == [(1, "a"), (2, "c"), (3, "d")]


def folders(path):
    return sorted(name for name in os.listdir(path) if "=" in name)


def test_a_thousand_batches_stay_few_folders(spark, tmp_path):
    """Batch folders are copies of a few; each hundredth batch folds the ones before."""
    schema = spark.createDataFrame([], "k bigint, v string").schema
    path = str(tmp_path / "table")
    for i in range(7):
        spark.createDataFrame([(i, f"v{i}"), (100 + i % 2, f"w{i}")], schema).write.parquet(f"{tmp_path}/b{i}")
    fold = lambda log: sinks._last_per_key(log, ["k"], keep_batch=True)
    most = 0
    for batch in range(1000):
        if batch and batch % 100 == 0:
            before = rows(sinks.read_upserted(spark, path, schema, ["k"]))
            sinks.compact(spark, path, schema, batch - 1, fold)
            assert rows(sinks.read_upserted(spark, path, schema, ["k"])) == before
        shutil.copytree(f"{tmp_path}/b{batch % 7}", f"{path}/batch={batch}")
        most = max(most, len(folders(path)))
    assert most <= 202
    expected = [(k, f"v{k}") for k in range(7)] + [(100, "w4"), (101, "w5")]  # batch 999 copies the sixth
    assert rows(sinks.read_upserted(spark, path, schema, ["k"])) == sorted(expected, key=repr)


def test_a_fold_that_failed_midway_is_not_seen(spark, tmp_path):
    path, schema = str(tmp_path / "table"), spark.createDataFrame([], "k bigint, v string").schema
    for batch, value in enumerate("abc"):
        spark.createDataFrame([(1, value)], schema).write.parquet(f"{path}/batch={batch}")
    sinks.compact(spark, path, schema, 1, lambda log: sinks._last_per_key(log, ["k"], keep_batch=True))
    assert folders(path) == ["base=1", "batch=0", "batch=1", "batch=2"]
    os.remove(f"{path}/base=1/_SUCCESS")
    assert rows(sinks.read_upserted(spark, path, schema, ["k"])) == [(1, "c")]
    sinks.compact(spark, path, schema, 1, lambda log: sinks._last_per_key(log, ["k"], keep_batch=True))
    sinks.compact(spark, path, schema, 2, lambda log: sinks._last_per_key(log, ["k"], keep_batch=True))
    assert folders(path) == ["base=1", "base=2", "batch=2"]
    assert rows(sinks.read_upserted(spark, path, schema, ["k"])) == [(1, "c")]
    assert rows(sinks.read_upserted(spark, str(tmp_path / "none"), schema, ["k"])) == []


def test_streams_fold_their_tables(spark, tmp_path, monkeypatch):
    """Fields of the latest state survive the folds, whichever batch brought them."""
    monkeypatch.setattr(sinks, "COMPACT_EVERY", 3)
    schema = "device_id bigint, seq bigint, ts timestamp, ph double, temperature double"
    source = str(tmp_path / "in")
    for i in range(11):
        one = [(i % 2, i, at(i), float(i) if i < 4 else None, None if i % 3 else float(i))]
        spark.createDataFrame(one, schema).coalesce(1).write.mode("append").parquet(source)
    readings = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "latest")
    sinks.latest_stream(readings, path, str(tmp_path / "p1")).awaitTermination()
    whole = spark.read.schema(schema).parquet(source)
    expected = latest_state(whole)
    assert rows(sinks.read_latest(spark, path, expected.schema)) == rows(expected)
    assert folders(path) == ["base=5", "base=8", "batch=10", "batch=6", "batch=7", "batch=8", "batch=9"]
    path = str(tmp_path / "upserted")
    counts = readings.groupBy("device_id").agg(F.count("*").alias("n"))
    sinks.upsert_stream(counts, path, str(tmp_path / "p2"), keys=["device_id"]).awaitTermination()
    assert rows(sinks.read_upserted(spark, path, counts.schema, ["device_id"])) == [(0, 6), (1, 5)]
    assert len(folders(path)) == 7


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
    assert fresh_dir(spark, "x").startswith(shared_dir(spark))


def test_a_written_table_cuts_the_lineage(spark):
    df = written(spark.range(5).withColumn("r", F.rand()), "x")
    assert rows(df) == rows(df)
    assert "Range" not in df._jdf.queryExecution().toString()


class Session:
    """A session without the setting."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(Session("spark://host"))


def test_a_local_master_gets_one_folder_of_its_own():
    session = Session("local[2]")
    assert os.path.isdir(shared_dir(session)) and shared_dir(session) == shared_dir(session)
