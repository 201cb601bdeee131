"""The services' work as jobs: the hourly batch job and the two ingest streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hydrolens import constants as C
from hydrolens.operators import alerts, control, quality, rollup
from hydrolens.sources import readings as source
from hydrolens.streaming import sinks, state


def kpi_job(spark: SparkSession, log_path: str, table: str, keyed_table: str) -> dict[str, int]:
    """Stored log to hourly indicators, as a table by date and as a keyed table.

    The log is scanned once: rows are counted on the way into the aggregation,
    and the keyed table is derived from the written indicators. Dates which do
    not occur in the log are left as they are.
    """
    counts = Observation("quality")
    clean = quality.clean(source.read_log(spark, log_path)).observe(
        counts,
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(quality.plausible()).alias("rows_kept"),
    )
    kpis = rollup.hourly_kpis(clean, ordered=False)
    sinks.overwrite_parquet(kpis, table, by_date_of="window_start")
    written = spark.read.schema(kpis.schema).parquet(table)
    sinks.overwrite_parquet(rollup.keyed_kpis(written), keyed_table)
    found = counts.get
    return {**found, "outliers": found["rows_in"] - found["rows_kept"]}


def http_ingest(
    raw: DataFrame,
    config_log: DataFrame,
    folder: str,
    rules: control.Rules = control.Rules(),
    available_now: bool = False,
    delay: str = "1 minute",
) -> list[StreamingQuery]:
    """Network ingest: smoothed readings to the log and the latest state, and
    the actions of the pump rules.

    Each reading meets the flags in force at its time, however the two inputs arrive, if
    rows are at most ``delay`` late. Later ones are listed in the part ``late=true`` of the
    table of actions, and take no part in any action.
    """
    readings = source.http_readings(raw)
    smoothed = state.smooth_ingest(readings)
    actions = state.pump_actions(readings, config_log, rules, C.SMOOTHING_ROWS, delay)
    actions = actions.withColumn(state.LATE, F.col("action") == state.LATE)
    return [
        sinks.readings_stream(smoothed, folder, f"{folder}/progress/readings", available_now),
        sinks.append_stream(
            actions, f"{folder}/actions", f"{folder}/progress/actions", available_now, state.LATE
        ),
    ]


def serial_ingest(
    raw: DataFrame, folder: str, available_now: bool = False
) -> list[StreamingQuery]:
    """Serial ingest: readings to the log and the latest state, alerts, and the
    refused lines."""
    readings = source.serial_readings(raw)
    refused = source.rejects(raw, "serial")
    messages = alerts.alert_json(alerts.alerts(readings))
    return [
        sinks.readings_stream(readings, folder, f"{folder}/progress/readings", available_now),
        sinks.append_stream(
            messages, f"{folder}/alerts", f"{folder}/progress/alerts", available_now
        ),
        sinks.append_stream(
            refused, f"{folder}/rejects", f"{folder}/progress/rejects", available_now
        ),
    ]
