"""Registered queries which run as streams over the whole tables.

Each reads the table's files as a stream, runs until all are read, and returns
the table its sink wrote. Hourly indicators, alerts, ingest and the latest state equal
the batch queries' however files are split and ordered. So do moving means and pump
actions with a delay; without one (and offline spans) they take a device's rows in the
order of their arrival, sorted within a micro-batch, as the services do, and equal the
batch queries' if files arrive in the order of time. The delay is measured on the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.operators import alerts, rollup
from hydrolens.plans.queries import _KPI_DOUBLES, RULES, SILENCE, Query, present
from hydrolens.sources import events_views as views
from hydrolens.sources import readings as source
from hydrolens.streaming import kpis, ranking, sinks, state


# Devices report every few hours here, so a bucket spans days instead of minutes.
WIDTH = "5 days"


def hourly_kpis_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = views.scattered(spark, sf_dir)
    hourly = kpis.hourly_kpis(views.readings(spark, sf_dir, folder=folder).filter("seq is not null"))
    return present(sinks.run_to_upserted(hourly, "kpis", ["window_start", "window_end"]), *_KPI_DOUBLES)


def kpi_keyed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = kpis.hourly_kpis(views.readings(spark, sf_dir, streaming=True))
    table = sinks.run_to_upserted(hourly, "kpis", ["window_start", "window_end"])
    return present(rollup.keyed_kpis(table), *_KPI_DOUBLES)


def ph_ma10_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings wait for earlier ones of files to come."""
    folder, delay = views.scattered(spark, sf_dir)
    rows = views.readings(spark, sf_dir, folder=folder).select("device_id", "seq", "ts", "ph")
    means = state.moving_mean(rows, {"ph": "ph_ma10"}, delay=delay, width=WIDTH)
    table = sinks.run_to_table(means, "ma10").filter(~F.col(state.LATE)).drop(state.LATE)
    return present(table, "ph_ma10")


def ingest_smoothed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    http = source.http_readings(views.readings_raw(spark, sf_dir, streaming=True))
    table = sinks.run_to_table(state.smooth_ingest(http, digits=None), "ingest")
    return present(table, "ph", "conductivity", "eletrocondutividade")


def alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raised = alerts.alerts(views.readings(spark, sf_dir, streaming=True), digits=2)
    return present(sinks.run_to_table(raised, "alerts"))


def ingest_json_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = source.http_readings(views.readings_raw(spark, sf_dir, streaming=True))
    return present(sinks.run_to_table(read, "ingest"))


def latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.readings_raw(spark, sf_dir, streaming=True)
    http = source.http_readings(raw.filter(F.col("source") == "http"))
    serial = source.serial_readings(raw.filter(F.col("source") == "serial"))
    return present(sinks.run_to_latest(source.unified(http, serial), "latest"))


def offline_spans_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = state.offline_spans(views.readings(spark, sf_dir, streaming=True), SILENCE)
    return present(state.settled_spans(sinks.run_to_table(spans, "offline")))


def pump_actions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of readings and of configuration with rows out of order, and not aligned."""
    (read, one), (wrote, other) = (views.scattered(spark, sf_dir, arrivals) for arrivals in (5, 3))
    rows = views.control_readings(spark, sf_dir, folder=read)
    writes = views.config_log(spark, sf_dir, folder=wrote)
    delay = max(one, other, key=lambda span: int(span.split()[0]))
    actions = state.pump_actions(rows, writes, RULES, delay=delay, width=WIDTH)
    return present(sinks.run_to_table(actions, "actions").filter(F.col("action") != state.LATE))


def temp_ranking_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are replaced by lower ones, in files with rows out of order."""
    folder, _ = views.scattered(spark, sf_dir, 4)
    rows = views.corrected(views.readings(spark, sf_dir, folder=folder).filter("seq is not null"))
    tops = sinks.run_to_upserted(ranking.bucket_tops(rows), "ranking", ranking.KEYS)
    return ranking.ranking(tops)


STREAMS: dict[str, Query] = {
    "hourly_kpis_stream": hourly_kpis_stream,
    "kpi_keyed_stream": kpi_keyed_stream,
    "ph_ma10_stream": ph_ma10_stream,
    "alerts_stream": alerts_stream,
    "ingest_json_stream": ingest_json_stream,
    "ingest_smoothed_stream": ingest_smoothed_stream,
    "latest_state_stream": latest_state_stream,
    "offline_spans_stream": offline_spans_stream,
    "pump_actions_stream": pump_actions_stream,
    "temp_ranking_stream": temp_ranking_stream,
}
