"""The registered queries: each runs an operator over whole tables.

Times are given out as wall-clock timestamps in UTC. Means and deviations are
rounded to six decimals here (not in the operators), since engines add doubles
in different orders. Rule times are scaled to the test data, whose devices
report every few hours instead of every five seconds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolens.operators import (
    alerts,
    calibration,
    changelog,
    config,
    control,
    latest,
    quality,
    report,
    rollup,
    smoothing,
)
from hydrolens.functions import payload, units
from hydrolens.plans import jobs
from hydrolens.session import fresh_dir, written
from hydrolens.sources import events_views as views
from hydrolens.sources import readings as source

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
HOUR = 3600
NOW = datetime(2024, 1, 30, 12)
BASE = datetime(2024, 1, 15)
SNAPSHOTS = (datetime(2024, 1, 16), datetime(2024, 1, 22), NOW)
RUNTIME_UNTIL = datetime(2024, 2, 1)
HASTENED_UNTIL = datetime(2024, 1, 1, 6)
SILENCE = 24 * HOUR
RULES = control.Rules(
    cooldown=6 * HOUR, dose_for=HOUR, cycle_every=12 * HOUR, cycle_for=5 * HOUR
)


def present(df: DataFrame, *rounded: str) -> DataFrame:
    """Wall-clock times, and the named doubles to six decimals."""
    changed = {
        field.name: F.col(field.name).cast("timestamp_ntz")
        for field in df.schema.fields
        if isinstance(field.dataType, T.TimestampType)
    }
    changed |= {name: F.round(name, DIGITS) for name in rounded}
    return df.withColumns(changed) if changed else df


# --- reads ------------------------------------------------------------------


def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(latest.latest_n(views.readings(spark, sf_dir)))


def history_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(latest.history_n(views.readings(spark, sf_dir)))


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.readings_raw(spark, sf_dir)
    http = source.http_readings(raw.filter(F.col("source") == "http"))
    serial = source.serial_readings(raw.filter(F.col("source") == "serial"))
    return source.unified(http, serial)


def unified_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_unified(spark, sf_dir))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(latest.latest_state(_unified(spark, sf_dir)))


def device_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = latest.latest_state(views.readings(spark, sf_dir))
    return present(latest.device_status(state, NOW, 12 * HOUR))


def temp_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.temperature_ranking(views.readings(spark, sf_dir))


def temp_ranking_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.device_temperature_ranking(views.readings(spark, sf_dir))


def reading_gaps(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    return present(smoothing.reading_gaps(views.readings(spark, sf_dir), rows_per_slice))


# --- ingest -----------------------------------------------------------------


def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.http_readings(views.readings_raw(spark, sf_dir)))


def ingest_json_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.http_readings(views.readings_raw(spark, sf_dir), missing="null"))


def ingest_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.readings_raw(spark, sf_dir)
    smoothed = smoothing.smooth_ingest(source.http_readings(raw), digits=None, raw=raw)
    return present(smoothed, "ph", "conductivity", "eletrocondutividade")


def normalize_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.serial_readings(views.readings_raw(spark, sf_dir)))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.rejects(views.readings_raw(spark, sf_dir), "http"))


def serial_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.rejects(views.readings_raw(spark, sf_dir), "serial"))


def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings accepted from the serial line, out of text files with one line each.

    A line is what the port's reader notes: arrival and payload, with a tab between.
    """
    raw = views.readings_raw(spark, sf_dir).filter(F.col("source") == "serial")
    micros = F.unix_micros("ts").cast("string")
    arrival = F.concat_ws(",", F.col("device_id").cast("string"), F.col("seq").cast("string"), micros)
    path = fresh_dir(spark, "lines")
    raw.select(F.concat(arrival, F.lit("\t"), "payload")).write.text(path)
    lines = source.read_lines(spark, path)
    noted = F.split(F.split_part("payload", F.lit("\t"), F.lit(1)), ",")
    arrived = lines.select(
        noted[0].cast("bigint").alias("device_id"),
        noted[1].cast("bigint").alias("seq"),
        F.timestamp_micros(noted[2].cast("bigint")).alias("ts"),
        F.split_part("payload", F.lit("\t"), F.lit(2)).alias("payload"),
    )
    return present(source.serial_readings(arrived))


def ingest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that arrive as bytes."""
    raw = views.readings_raw(spark, sf_dir)
    sent = raw.withColumn("payload", F.encode("payload", "UTF-8"))
    text = sent.withColumn("payload", payload.decode_text(F.col("payload")))
    return present(source.http_readings(text))


def kpi_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job end to end: the stored log is written, read by the job, and the
    keyed table it leaves is read back."""
    log, table, keyed = (fresh_dir(spark, name) for name in ("log", "kpis", "keyed"))
    views.reading_log(spark, sf_dir).write.parquet(log)
    jobs.kpi_job(spark, log, table, keyed)
    return present(spark.read.parquet(keyed).drop("date"), *_KPI_DOUBLES)


def encode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.encode_json(source.decode_adc(views.adc_raw(spark, sf_dir))))


# --- units ------------------------------------------------------------------


def decode_adc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(source.decode_adc(views.adc_raw(spark, sf_dir)))


def ph_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.readings(spark, sf_dir)
    volts = units.ph_to_volts(F.col("raw_ph"))
    return rows.select("device_id", "seq", "raw_ph", volts.alias("voltage"))


def ph_ingest_cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.readings(spark, sf_dir)
    ph = units.ingest_ph(units.ph_to_volts(F.col("raw_ph")))
    return rows.select("device_id", "seq", "raw_ph", ph.alias("ph"))


def ec_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ppm = F.col("value") * 3
    return views.rows(spark, sf_dir).select(
        "device_id", "seq", units.ppm_to_conductivity(ppm).alias("conductivity")
    )


def water_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = (F.col("k") % 25).cast("double")
    return views.rows(spark, sf_dir).select(
        "device_id", "seq", distance.alias("distance"),
        units.water_level(distance).alias("water_level"),
    )


# --- quality ----------------------------------------------------------------


def log_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.untimed(views.reading_log(spark, sf_dir))
    return found.select("device_id", "seq", "stream_id", "timestamp", "reason")


def clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(quality.clean(views.reading_log(spark, sf_dir)))


def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(quality.without_outliers(views.readings(spark, sf_dir)))


def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlier_counts(quality.clean(views.reading_log(spark, sf_dir)))


def range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(quality.range_status(views.readings(spark, sf_dir)))


# --- roll-up and smoothing --------------------------------------------------

_KPI_DOUBLES = ("avg_temp", "avg_ph", "avg_humidity", "stddev_temp")


def hourly_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(rollup.hourly_kpis(views.readings(spark, sf_dir)), *_KPI_DOUBLES)


def hourly_kpis_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored partial windows of the first readings, merged with those of a late batch."""
    rows, late = views.readings(spark, sf_dir), F.col("seq") % 3 == 0
    stored, batch = (written(rollup.partial_windows(rows.filter(half)), "kpi-partials") for half in (~late, late))
    merged = rollup.merge_windows(stored.unionByName(batch))
    return present(rollup.settle_windows(merged), *_KPI_DOUBLES)


def hourly_kpis_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = rollup.hourly_kpis(views.readings(spark, sf_dir), by=("device_id",), ordered=False)
    return present(kpis, *_KPI_DOUBLES)


def kpi_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = quality.without_outliers(views.readings(spark, sf_dir))
    return present(rollup.keyed_kpis(rollup.aggregate_windows(clean)), *_KPI_DOUBLES)


def log_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch job: stored log, cleaning, outliers, hourly indicators."""
    clean = quality.clean(views.reading_log(spark, sf_dir))
    return present(rollup.hourly_kpis(clean), *_KPI_DOUBLES)


def _moving_mean(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None) -> DataFrame:
        rows = views.readings(spark, sf_dir).select("device_id", "seq", "ts", name)
        out = f"{name}_ma10"
        means = smoothing.moving_mean(rows, {name: out}, rows_per_slice=rows_per_slice)
        return present(means, out)

    return query


# --- calibration ------------------------------------------------------------


def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.live_points(views.calibration_log(spark, sf_dir))


def calibration_requests(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    asked = views.calibration_requests(spark, sf_dir)
    known = views.rows(spark, sf_dir).filter(F.col("event_type") != "purchase")
    read = views.readings_of(known)
    return present(calibration.points_from_requests(asked, read, rows_per_slice))


def calibration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.status(calibration.live_points(views.calibration_log(spark, sf_dir)))


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.report(calibration.live_points(views.calibration_log(spark, sf_dir)))


def calibration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.line(calibration.live_points(views.calibration_log(spark, sf_dir)))


def calibrated_ph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.readings(spark, sf_dir).select("device_id", "seq", "ts", "raw_ph")
    points = calibration.live_points(views.calibration_log(spark, sf_dir))
    applied = calibration.apply_current(rows, points, digits=None)
    return present(applied.drop("slope", "intercept"))


def calibrated_ph_asof(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    events = views.rows(spark, sf_dir).filter(F.col("event_type") != "purchase")
    rows = views.readings_of(events).select("device_id", "seq", "ts", "raw_ph")
    log = views.calibration_log(spark, sf_dir)
    return present(calibration.apply_as_of(rows, log, None, rows_per_slice))


# --- configuration and control ----------------------------------------------


def config_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(config.config_current(views.config_log(spark, sf_dir)))


def config_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(config.config_writes(views.config_requests(spark, sf_dir)))


def config_asof(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    rows = views.control_readings(spark, sf_dir).select("device_id", "seq", "ts", "conductivity")
    return present(config.config_as_of(rows, views.config_log(spark, sf_dir), rows_per_slice))


def config_asof_nulls(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    """Some devices unnamed: these count as one device."""
    rows = views.control_readings(spark, sf_dir).select("device_id", "seq", "ts", "conductivity")
    log = views.unnamed(views.config_log(spark, sf_dir))
    return present(config.config_as_of(views.unnamed(rows), log, rows_per_slice))


def _smoothed(spark: SparkSession, sf_dir: str, rows_per_slice: int | None) -> DataFrame:
    """Control readings with the smoothed conductivity the rules look at."""
    rows = views.control_readings(spark, sf_dir).select("device_id", "seq", "ts", "conductivity")
    return smoothing.moving_mean(
        rows, {"conductivity": "conductivity"}, digits=2, rows_per_slice=rows_per_slice
    )


def dose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _smoothed(spark, sf_dir, None)
    found = config.dose_candidates(rows, views.config_log(spark, sf_dir))
    return present(found.select("device_id", "seq", "ts", "circ", "auto"))


def _actions(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    rows = _smoothed(spark, sf_dir, rows_per_slice)
    return control.actions(rows, views.config_log(spark, sf_dir), RULES, rows_per_slice)


def pump_actions(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    return present(_actions(spark, sf_dir, rows_per_slice))


def _default_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Configuration and actions of the rules as shipped, on hastened readings."""
    rows = views.hastened(views.control_readings(spark, sf_dir))
    rows = rows.select("device_id", "seq", "ts", "conductivity")
    log = views.hastened(views.config_log(spark, sf_dir))
    means = smoothing.moving_mean(rows, {"conductivity": "conductivity"}, digits=2)
    return log, control.actions(means, log)


def pump_actions_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_default_actions(spark, sf_dir)[1])


def pump_runtime_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline = control.pump_timeline(*_default_actions(spark, sf_dir), sized_by=views.rows(spark, sf_dir))
    return present(control.pump_runtime(timeline, HASTENED_UNTIL))


def dose_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(control.dose_events(_actions(spark, sf_dir)))


def circ_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(control.circulation_cycles(_actions(spark, sf_dir)))


def last_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(control.last_actions(_actions(spark, sf_dir)))


def _timeline(spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None) -> DataFrame:
    log = views.config_log(spark, sf_dir)
    done = _actions(spark, sf_dir, rows_per_slice)
    return control.pump_timeline(log, done, rows_per_slice, sized_by=views.rows(spark, sf_dir))


def pump_timeline(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    return present(_timeline(spark, sf_dir, rows_per_slice))


def pump_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(control.pump_runtime(_timeline(spark, sf_dir), RUNTIME_UNTIL))


# --- alerts and report ------------------------------------------------------


def raise_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(alerts.alerts(views.readings(spark, sf_dir), digits=2))


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(alerts.alert_json(alerts.alerts(views.readings(spark, sf_dir), digits=2)))


def offline_spans(
    spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None
) -> DataFrame:
    rows = views.readings(spark, sf_dir)
    return present(alerts.offline_spans(rows, NOW, SILENCE, rows_per_slice))


def context_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.context_report(views.readings(spark, sf_dir))


# --- change log -------------------------------------------------------------


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.snapshot(views.kv_log(spark, sf_dir), NOW)


def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_snapshot(spark, sf_dir))


def kv_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots at three times from a base that is written once and what came since,
    entries that are older than the base but came late included."""
    log = views.kv_log(spark, sf_dir)
    by_then = (F.col("ts") <= F.lit(BASE)) & ~views.kv_late()
    base = written(changelog.newest(log.filter(by_then)), "kv-base")
    both = base.unionByName(log.filter(~by_then))
    each = [changelog.snapshot(both, at).select(F.lit(at).cast("timestamp").alias("at"), "*") for at in SNAPSHOTS]
    return present(reduce(DataFrame.unionByName, each))


def kv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.kv_log(spark, sf_dir).select("key").distinct()
    return changelog.lookup(_snapshot(spark, sf_dir), keys)


def kv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.list_keys(_snapshot(spark, sf_dir), "*i*:?[1-4]")


def kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot without the keys which were ever deleted."""
    log = views.kv_log(spark, sf_dir)
    gone = log.filter(F.col("op") == "delete").select("key").distinct()
    return present(changelog.delete_keys(_snapshot(spark, sf_dir), gone))


BATCH: dict[str, Query] = {
    "latest_n": latest_n,
    "history_n": history_n,
    "unified_readings": unified_readings,
    "latest_state": latest_state,
    "device_status": device_status,
    "temp_ranking": temp_ranking,
    "temp_ranking_by_device": temp_ranking_by_device,
    "reading_gaps": reading_gaps,
    "ingest_json": ingest_json,
    "ingest_json_sparse": ingest_json_sparse,
    "ingest_smoothed": ingest_smoothed,
    "ingest_lines": ingest_lines,
    "ingest_bytes": ingest_bytes,
    "ingest_rejects": ingest_rejects,
    "normalize_serial": normalize_serial,
    "serial_rejects": serial_rejects,
    "encode_json": encode_json,
    "decode_adc": decode_adc,
    "ph_voltage": ph_voltage,
    "ph_ingest_cal": ph_ingest_cal,
    "ec_convert": ec_convert,
    "water_level": water_level,
    "clean_readings": clean_readings,
    "log_rejects": log_rejects,
    "outlier_filter": outlier_filter,
    "outlier_counts": outlier_counts,
    "range_status": range_status,
    "hourly_kpis": hourly_kpis,
    "hourly_kpis_by_device": hourly_kpis_by_device,
    "hourly_kpis_merged": hourly_kpis_merged,
    "kpi_keyed": kpi_keyed,
    "log_kpis": log_kpis,
    "kpi_job": kpi_job,
    "ph_ma10": _moving_mean("ph"),
    "ec_ma10": _moving_mean("conductivity"),
    "calibration_points": calibration_points,
    "calibration_requests": calibration_requests,
    "calibration_status": calibration_status,
    "calibration_report": calibration_report,
    "calibration_line": calibration_line,
    "calibrated_ph": calibrated_ph,
    "calibrated_ph_asof": calibrated_ph_asof,
    "config_writes": config_writes,
    "config_current": config_current,
    "config_asof": config_asof,
    "config_asof_nulls": config_asof_nulls,
    "dose_candidates": dose_candidates,
    "dose_events": dose_events,
    "circ_cycles": circ_cycles,
    "pump_actions": pump_actions,
    "pump_actions_default": pump_actions_default,
    "last_actions": last_actions,
    "pump_timeline": pump_timeline,
    "pump_runtime": pump_runtime,
    "pump_runtime_default": pump_runtime_default,
    "alerts": raise_alerts,
    "alert_messages": alert_messages,
    "offline_spans": offline_spans,
    "context_report": context_report,
    "kv_snapshot": kv_snapshot,
    "kv_snapshots": kv_snapshots,
    "kv_lookup": kv_lookup,
    "kv_list": kv_list,
    "kv_delete": kv_delete,
}
