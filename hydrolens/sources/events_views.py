"""Telemetry tables derived from the ``events`` test table.

The test data holds no sensor tables, so each row of ``events`` stands for one
arrival: a reading, a configuration write, a calibration entry or a key-value
command. All views are projections and filters, so Catalyst pushes them into
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens import schemas
from hydrolens.functions import units
from hydrolens.session import fresh_dir
from hydrolens.sources.readings import stream_table


def scattered(spark: SparkSession, sf_dir: str, arrivals: int = 6) -> tuple[str, str]:
    """All events as files in which rows come up to a tenth of the table's span late, and
    the delay that covers this, measured.

    Events arrive at their time plus a share of that tenth, and are dealt by arrival to
    ``arrivals`` parts of about equal spans, written one after the other. After them comes a file of
    two events of no device, a year later, that let a stream close what it holds.
    """
    folder = fresh_dir(spark, "scattered")
    events = spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")
    first, last, count = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    if not count:
        events.write.parquet(folder)
        return folder, "0 seconds"
    start, span = (F.unix_micros(F.lit(at).cast("timestamp")) for at in (first, last))
    span = F.greatest(span - start, F.lit(arrivals))
    late = F.pmod(F.xxhash64("event_id"), F.greatest(F.expr("1"), (span / 10).cast("long")))
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) - start + late
    part = F.least(F.lit(arrivals - 1), (arrival * arrivals / (span * 1.1)).cast("int"))
    dealt = events.withColumn("part", part)
    spans = dealt.groupBy("part").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).orderBy("part").collect()
    delay = max(max(s.last for s in spans[: i + 1]) - min(s.first for s in spans[i:]) for i in range(len(spans)))
    for number in range(arrivals):
        own = dealt.filter(F.col("part") == number).drop("part")
        own.coalesce(1 + count // (arrivals * ROWS_PER_FILE)).write.mode("append").parquet(folder)
    end = events.agg(F.max("ts").alias("ts")).withColumn("ts", F.col("ts") + F.expr("interval 1 year"))
    kind = F.explode(F.array(F.lit("signup"), F.lit("view"))).alias("event_type")
    closing = end.select("ts", kind)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in events.schema if f.name not in closing.columns}
    closing = closing.withColumns(blank).select(*events.columns).coalesce(1)
    closing.write.mode("append").parquet(folder)
    return folder, f"{int(delay.total_seconds()) + 1} seconds"


# Rows of one file that a stream takes at once.
ROWS_PER_FILE = 1_000_000


def rows(
    spark: SparkSession, sf_dir: str, streaming: bool = False, folder: str | None = None
) -> DataFrame:
    """All events with the telemetry keys; ``ts`` is an instant, not a wall clock.

    ``folder`` is a :func:`scattered` one, streamed file by file.
    """
    if folder is not None:
        events = stream_table(spark, folder, schemas.EVENTS, 1)
    elif streaming:
        events = stream_table(spark, sf_dir, schemas.EVENTS, pathGlobFilter="events.parquet")
    else:
        events = spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def readings_of(events: DataFrame) -> DataFrame:
    raw_ph = F.lit(11) + (F.col("value") % 25) / 10
    measured = events.select(
        "device_id",
        "seq",
        "ts",
        (F.col("value") % 75 - 12).alias("temperature"),
        (F.lit(30.0) + F.col("k") % 60).alias("humidity"),
        (F.col("k") % 25).cast("double").alias("distance"),
        (F.col("value") * 3).alias("ppm"),
        raw_ph.alias("raw_ph"),
    )
    return measured.select(
        "device_id",
        "seq",
        "ts",
        "temperature",
        "humidity",
        "distance",
        units.water_level(F.col("distance")).alias("water_level"),
        units.ppm_to_conductivity(F.col("ppm")).alias("conductivity"),
        "raw_ph",
        units.ingest_ph(units.ph_to_volts(F.col("raw_ph"))).alias("ph"),
    )


def readings(
    spark: SparkSession, sf_dir: str, streaming: bool = False, folder: str | None = None
) -> DataFrame:
    """Every event as a reading."""
    return readings_of(rows(spark, sf_dir, streaming, folder))


def control_readings(
    spark: SparkSession, sf_dir: str, streaming: bool = False, folder: str | None = None
) -> DataFrame:
    """Events that are not configuration writes, as readings."""
    events = rows(spark, sf_dir, streaming, folder)
    return readings_of(events.filter(F.col("event_type") != "signup"))


def config_log(
    spark: SparkSession, sf_dir: str, streaming: bool = False, folder: str | None = None
) -> DataFrame:
    k = F.col("k")
    return (
        rows(spark, sf_dir, streaming, folder)
        .filter(F.col("event_type") == "signup")
        .select(
            "device_id",
            "seq",
            "ts",
            (k % 2).cast("int").alias("circ"),
            F.lit(0).alias("nutri"),
            (k % 3 > 0).cast("int").alias("auto"),
            (k % 5 > 0).cast("int").alias("circ_auto"),
        )
    )


def config_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration writes as they are sent: true, false, or left out."""
    k = F.col("k")
    return (
        rows(spark, sf_dir)
        .filter(F.col("event_type") == "signup")
        .select(
            "device_id",
            "seq",
            "ts",
            F.when(k % 4 > 0, k % 2 == 1).alias("circ"),
            F.when(k % 7 > 0, k % 3 > 0).alias("auto"),
            (k % 5 > 0).alias("circ_auto"),
        )
    )


# The first instant of the test data, in microseconds.
_START = 1_704_067_200_000_000


def hastened(rows: DataFrame, times: int = 360) -> DataFrame:
    """The rows with time running so many times as fast: readings come every minute or so
    instead of every few hours, which suits the rules' own thresholds."""
    passed = F.expr(f"(unix_micros(ts) - {_START}) div {times}")
    return rows.withColumn("ts", F.timestamp_micros(passed + _START))


def unnamed(rows: DataFrame) -> DataFrame:
    """The rows with every seventh device's name left out."""
    return rows.withColumn("device_id", F.when(F.col("device_id") % 7 != 0, F.col("device_id")))


def calibration_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    is_reset = k % 20 == 0
    return (
        rows(spark, sf_dir)
        .filter(F.col("event_type") == "purchase")
        .select(
            "device_id",
            "seq",
            "ts",
            F.when(is_reset, "reset").otherwise("add").alias("op"),
            F.when(~is_reset, F.lit(1.0) + k / F.lit(100.0)).alias("voltage"),
            F.when(~is_reset, (F.lit(4) + k % 7).cast("double")).alias("ph"),
        )
    )


def calibration_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as requests to calibrate the latest reading to a known pH."""
    known = (F.lit(4) + F.col("k") % 7).cast("double")
    asked = rows(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return asked.select("device_id", "seq", "ts", known.alias("known_ph"))


def corrected(readings: DataFrame) -> DataFrame:
    """Readings, and for every third a second one of its instant, 20 degrees lower."""
    again = F.when(F.col("seq") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = readings.withColumn("again", F.explode(again))
    return sent.withColumns(
        {"seq": F.col("seq") + F.col("again") * 1_000_000_000_000, "temperature": F.col("temperature") - 20 * F.col("again")}
    ).drop("again")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry. Some come two days late, some have no key, some are sent
    twice, and of those some with another value the second time."""
    seq = F.col("seq")
    deleted = seq % 11 == 0
    copies = F.when((seq % 17 == 0) | (seq % 19 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = F.when((seq % 19 == 0) & (F.col("copy") == 1), F.lit("b")).otherwise(F.lit(""))
    sent = rows(spark, sf_dir).withColumn("copy", F.explode(copies))
    key = F.concat("event_type", F.lit(":"), F.col("k").cast("string"))
    return sent.select(
        F.when(seq % 101 != 0, key).alias("key"),
        "seq",
        F.when(kv_late(), F.col("ts") - F.expr("interval 2 days")).otherwise(F.col("ts")).alias("ts"),
        F.when(deleted, "delete").otherwise("set").alias("op"),
        F.when(~deleted, F.concat(seq.cast("string"), again)).alias("value"),
        F.when(~deleted & (seq % 7 == 0), F.lit(86400)).cast("bigint").alias("expire_s"),
    )


def kv_late() -> Column:
    return F.col("seq") % 13 == 0


def adc_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seq = F.col("k"), F.col("seq")
    humidity = F.when(k % 10 == 0, F.lit(float("nan"))).otherwise(F.lit(30.0) + k % 60)
    return rows(spark, sf_dir).select(
        "device_id",
        "seq",
        "ts",
        (seq * 37 % 4096).cast("int").alias("tds_adc"),
        (seq * 101 % 4096).cast("int").alias("ph_adc"),
        (F.lit(100) + k * 15).alias("echo_us"),
        (F.col("value") % 75 - 12).alias("temperature"),
        humidity.alias("humidity"),
    )


# Payload of one arrival as SQL text that Spark and the SQL check both run.
_TEXT = {
    "t": "CAST(CAST(value % 75 - 12 AS DECIMAL(10,2)) AS {text})",
    "h": "CAST(30 + k % 60 AS {text})",
    "d": "CAST(k % 25 AS {text})",
    "p": "CAST(CAST(11 + (value % 25) / 10 AS DECIMAL(10,3)) AS {text})",
    "e": "CAST(CAST(value * 3 AS DECIMAL(12,2)) AS {text})",
    "ms": "CAST(1704067200000 + seq * 1000 AS {text})",
}
_SHAPES = [
    ("seq % 37 = 0", '{"ph": <p>'),
    ("seq % 41 = 0", "[1, 2]"),
    ("seq % 43 = 0", "{}"),
    ("seq % 47 = 0", '{"temperatura": null, "temperature": <t>, "umidade": <h>, "ph": <p>}'),
    ("seq % 53 = 0", '{"pH": <p>, "salinidade": <e>, "temperature": <t>, "timestamp": <ms>}'),
    ("seq % 59 = 0", '{"temperatura": <t>, "umidade": <h>, "distancia": <d>, "ph": "x"}'),
    ("seq % 61 = 0", '{"temperature": <t>, "humidity": <h>, "conductivity": <e>}'),
    ("seq % 67 = 0", '{"ph": <p>, "temperatura": <t>}{"ph": <p>}'),
    ("seq % 73 = 0", '{"ph": 1e30, "temperatura": <t>, "umidade": <h>, "distancia": 1e300}'),
    ("seq % 79 = 0", '{"temperatura": <t>, "umidade": <h>, "ph": <t>, "ph": <p>}'),
    ("seq % 83 = 0", '{"ph": <p>, "temperatura": <t>, "timestamp": 1e18}'),
    ("seq % 89 = 0", '{"ph": <p>, "umidade": <h>, "timestamp": "soon"}'),
    ("seq % 97 = 0", '{"ph": "inf", "temperatura": "inf", "umidade": <h>, "timestamp": "1e30"}'),
    ("seq % 71 = 0", '{"ph": <p>, "eletrocondutividade": null, "temperatura": <t>}'),
    (
        "seq % 2 = 0",
        '{"temperatura": <t>, "umidade": <h>, "distancia": <d>, "ph": <p>, '
        '"eletrocondutividade": <e>}',
    ),
    (
        None,
        '{"temperature": <t>, "humidity": <h>, "distance": <d>, "ph": <p>, '
        '"conductivity": <e>}',
    ),
]


def payload_sql(text_type: str) -> str:
    """CASE expression over ``seq``, ``value`` and ``k`` that builds the payload."""

    def build(shape: str) -> str:
        pieces = [f"'{shape}'"]
        for name, sql in _TEXT.items():
            split = f"', {sql.format(text=text_type)}, '"
            pieces = [piece.replace(f"<{name}>", split) for piece in pieces]
        return "concat(" + ", ".join(pieces) + ")"

    cases = [f"WHEN {test} THEN {build(shape)}" for test, shape in _SHAPES if test]
    return "CASE " + " ".join(cases) + f" ELSE {build(_SHAPES[-1][1])} END"


def readings_raw(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Every event as a payload; one in three came over the serial line."""
    return rows(spark, sf_dir, streaming).select(
        "device_id",
        "seq",
        "ts",
        F.when(F.col("seq") % 3 == 0, "serial").otherwise("http").alias("source"),
        F.expr(payload_sql("string")).alias("payload"),
    )


def reading_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry of the stored log: texts, some of them unreadable."""
    k, seq = F.col("k"), F.col("seq")
    millis = F.unix_millis("ts").cast("string")

    def as_text(value: str, digits: int):
        return F.expr(f"CAST(CAST({value} AS DECIMAL(12,{digits})) AS string)")

    return rows(spark, sf_dir).select(
        "device_id",
        "seq",
        F.concat(millis, F.lit("-"), seq.cast("string")).alias("stream_id"),
        F.when(seq % 29 == 0, F.lit("n/a")).otherwise(as_text("value % 75 - 12", 2)).alias(
            "temperature"
        ),
        (F.lit(30) + k % 60).cast("string").alias("humidity"),
        F.when(seq % 61 == 0, F.lit("1e30"))
        .when(seq % 67 == 0, F.lit("nan"))
        .when(seq % 31 != 0, as_text("value % 15", 2))
        .alias("ph"),
        as_text("value * 6", 2).alias("conductivity"),
        (k % 25).cast("string").alias("distance"),
        F.when(seq % 37 == 0, F.lit("nan"))
        .when(seq % 41 == 0, F.lit("1e18"))
        .when(seq % 43 == 0, F.lit("-inf"))
        .when(seq % 47 == 0, F.lit("soon"))
        .when(seq % 53 == 0, F.lit("1e30"))
        .when(seq % 23 != 0, millis)
        .alias("timestamp"),
    )
