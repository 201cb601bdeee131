"""The jobs end to end on the test tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolens import schemas
from hydrolens.operators import control, latest, quality, rollup, smoothing
from hydrolens.plans import jobs
from hydrolens.sources import events_views as views
from hydrolens.sources import readings as source
from hydrolens.sources.readings import stream_table
from hydrolens.streaming import sinks
from tests.helpers import rows


def test_kpi_job(spark, sf_dir, tmp_path):
    log = views.reading_log(spark, sf_dir)
    path, table, keyed = (str(tmp_path / name) for name in ("log", "kpis", "keyed"))
    log.write.parquet(path)
    counts = jobs.kpi_job(spark, path, table, keyed)
    (expected,) = quality.outlier_counts(quality.clean(log)).collect()
    assert counts == {name: expected[name] for name in ("rows_in", "rows_kept", "outliers")}
    kpis = rollup.hourly_kpis(quality.clean(log))
    names = ["window_start", "max_temp", F.round("avg_temp", 6)]
    assert rows(spark.read.parquet(table).select(*names)) == rows(kpis.select(*names))
    assert spark.read.parquet(keyed).select("kpi_key").distinct().count() == kpis.count()
    assert jobs.kpi_job(spark, path, table, keyed) == counts
    assert spark.read.parquet(table).count() == kpis.count()


@pytest.fixture()
def streams(spark, sf_dir, tmp_path):
    raw_path, config_path = str(tmp_path / "raw"), str(tmp_path / "config")
    views.readings_raw(spark, sf_dir).coalesce(1).write.parquet(raw_path)
    views.config_log(spark, sf_dir).coalesce(1).write.parquet(config_path)
    return (
        stream_table(spark, raw_path, schemas.READINGS_RAW),
        stream_table(spark, config_path, schemas.CONFIG_LOG),
    )


@pytest.mark.parametrize(("parts", "others"), [(1, 1), (4, 2)])
def test_http_ingest(spark, sf_dir, tmp_path, parts, others):
    """Actions are exact however the files of the two inputs are split; rows beyond the
    delay are listed and take no part."""
    rules = control.Rules(cooldown=21600, dose_for=3600, cycle_every=43200, cycle_for=18000)
    raw, log = views.readings_raw(spark, sf_dir).filter("seq % 3 > 0"), views.config_log(spark, sf_dir)
    newest = raw.agg(F.max("ts")).first()[0]
    end = F.lit(newest) + F.expr("interval 1 day")  # a row of no device that closes what is held
    closing = [rows_.orderBy("ts").limit(1).withColumns({"device_id": F.lit(None).cast("bigint"), "ts": end}) for rows_ in (raw, log)]
    late = raw.orderBy("ts").limit(3)
    behind = [late.withColumns({"seq": F.col("seq") + 10**9, "ts": F.col("ts") - F.expr("interval 9 days")})]
    paths = []
    for name, whole, extra, number in (("raw", raw, [closing[0], *behind], parts), ("config", log, [closing[1]], others)):
        path = str(tmp_path / name)
        part = F.ntile(number).over(Window.orderBy("ts"))
        for i in range(number):
            # Within a file rows lie in no order.
            whole.withColumn("part", part).filter(F.col("part") == i + 1).drop("part").orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(path)
        for one in extra:
            one.coalesce(1).write.mode("append").parquet(path)
        paths.append(path)
    streams = [stream_table(spark, path, schema, 1) for path, schema in zip(paths, (schemas.READINGS_RAW, schemas.CONFIG_LOG))]
    folder = str(tmp_path / "out")
    for query in jobs.http_ingest(*streams, folder, rules, available_now=True, delay="1 minute"):
        query.awaitTermination()
    read = source.http_readings(raw)
    found = spark.read.parquet(f"{folder}/readings").drop("batch").filter("device_id IS NOT NULL AND seq < 1e9")
    assert rows(found, "seq", "temperature", "water_level") == rows(read, "seq", "temperature", "water_level")
    state = sinks.read_latest(spark, f"{folder}/latest", latest.latest_state(found).schema).filter("device_id IS NOT NULL")
    # Late readings are the newest arrivals of their devices.
    on_time = state.join(late.select("device_id"), "device_id", "left_anti")
    expected = latest.latest_state(read).join(late.select("device_id"), "device_id", "left_anti")
    assert rows(on_time, "device_id", "ts", "raw_ph") == rows(expected, "device_id", "ts", "raw_ph")
    smooth = smoothing.moving_mean(read, {"conductivity": "conductivity"}, digits=2)
    done = control.actions(smooth, log, rules)
    actions = spark.read.parquet(f"{folder}/actions").filter("device_id IS NOT NULL")
    assert rows(actions.filter("late = 'false'"), *done.columns) == rows(done)
    told = rows(actions.filter("late = 'true'"), "seq", "action")
    assert told == [(row.seq + 10**9, "late") for row in sorted(late.collect(), key=lambda row: row.seq)]


def test_serial_ingest(spark, sf_dir, streams, tmp_path):
    raw, _ = streams
    folder = str(tmp_path / "out")
    for query in jobs.serial_ingest(raw, folder, available_now=True):
        query.awaitTermination()
    expected = source.serial_readings(views.readings_raw(spark, sf_dir))
    found = spark.read.parquet(f"{folder}/readings").drop("batch")
    assert rows(found, "seq", "ts", "ph", "salinity") == rows(expected, "seq", "ts", "ph", "salinity")
    refused = spark.read.parquet(f"{folder}/rejects").count()
    assert refused > 0 and refused + found.count() == views.rows(spark, sf_dir).count()
    assert spark.read.parquet(f"{folder}/alerts").columns == ["device_id", "ts", "value"]
