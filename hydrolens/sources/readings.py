"""Sources of readings: payload tables, JSON lines and the stored reading log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens import schemas
from hydrolens.functions import payload as P
from hydrolens.functions import units

ARRIVAL = ("device_id", "seq", "ts")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def stream_table(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64, **options: str
) -> DataFrame:
    """The same table as a stream of its files.

    The limit bounds a micro-batch, and with it what a stateful operator sorts
    per device at once.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).parquet(path)


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines as ``payload``; blank lines are not records."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(path)
    return lines.select(F.trim("value").alias("payload")).filter(F.length("payload") > 0)


def event_time(ts_ms: Column, arrival: Column | None = None) -> Column:
    """Epoch milliseconds to a timestamp; arrival time where there are none."""
    arrival = F.current_timestamp() if arrival is None else arrival
    return F.coalesce(P.instant(ts_ms), arrival)


def _bad(name: str) -> Column:
    """A key that is there without a readable number."""
    return F.col(f"fields.{name}.present") & F.col(f"fields.{name}.number").isNull()


def _empty(name: str) -> Column:
    return F.col(f"fields.{name}.empty")


def _http_reason() -> Column:
    """Why the network ingest refuses a payload, null where it takes it."""
    return (
        F.when(F.col("fields").isNull(), F.lit("malformed"))
        .when(_bad("ppm") | _bad("distance") | _bad("raw_ph"), F.lit("bad number"))
        .when(_empty("temperature") | _empty("humidity"), F.lit("null value"))
    )


def http_readings(raw: DataFrame, missing: str = "zero") -> DataFrame:
    """Payloads of the network ingest as readings, before smoothing.

    ``missing="zero"`` reads an absent key as 0, the way the service does;
    ``missing="null"`` keeps it absent. Refused payloads are left to
    :func:`rejects`.
    """

    def number(name: str) -> Column:
        value = F.col(f"fields.{name}.number")
        if missing == "zero":
            value = F.when(F.col(f"fields.{name}.present"), value).otherwise(0.0)
        return value.alias(name)

    parsed = P.with_fields(raw, C.HTTP_KEYS)
    taken = parsed.filter(_http_reason().isNull()).select(
        *ARRIVAL, *[number(name) for name in C.HTTP_KEYS]
    )
    return taken.select(
        *ARRIVAL,
        F.lit("http").alias("source"),
        "temperature",
        "humidity",
        "distance",
        units.water_level(F.col("distance")).alias("water_level"),
        units.ppm_to_conductivity(F.col("ppm")).alias("conductivity"),
        "raw_ph",
        units.ingest_ph(units.ph_to_volts(F.col("raw_ph"))).alias("ph"),
    )


_SERIAL_FIELDS = {**C.SERIAL_KEYS, "timestamp": ("timestamp",)}


def _serial_reason() -> Column:
    """Why the serial ingest skips a line, null where it takes it."""
    any_key = any_bad = F.lit(False)
    for name in _SERIAL_FIELDS:
        any_key = any_key | F.col(f"fields.{name}.present")
    for name in C.SERIAL_KEYS:
        any_bad = any_bad | _bad(name)
    return (
        F.when(F.col("fields").isNull(), F.lit("malformed"))
        .when(~any_key, F.lit("empty"))
        .when(any_bad, F.lit("bad number"))
        .when(
            F.col("fields.timestamp.present")
            & ~F.col("fields.timestamp.empty")
            & P.instant(F.col("fields.timestamp.number")).isNull(),
            F.lit("bad time"),
        )
    )


def serial_readings(raw: DataFrame) -> DataFrame:
    """Payloads of the serial ingest as sparse readings.

    A ``timestamp`` in the payload is the event time; the arrival time stands in
    for an absent or null one, and one that is no time is refused. Conductivity stays in ppm on this path.
    """
    parsed = P.with_fields(raw, _SERIAL_FIELDS)
    taken = parsed.filter(_serial_reason().isNull()).select(
        "device_id",
        "seq",
        event_time(F.col("fields.timestamp.number"), F.col("ts")).alias("ts"),
        *[F.col(f"fields.{name}.number").alias(name) for name in C.SERIAL_KEYS],
    )
    return taken.select(
        *ARRIVAL,
        F.lit("serial").alias("source"),
        "temperature",
        "humidity",
        "distance",
        "conductivity",
        "salinity",
        units.serial_ph(F.col("ph")).alias("ph"),
    )


def rejects(raw: DataFrame, path: str = "http") -> DataFrame:
    """Refused payloads with the reason; the complement of the two readers."""
    keys, reason = (
        (C.HTTP_KEYS, _http_reason()) if path == "http" else (_SERIAL_FIELDS, _serial_reason())
    )
    judged = P.with_fields(raw, keys).select(*ARRIVAL, "payload", reason.alias("reason"))
    return judged.filter(F.col("reason").isNotNull())


def unified(http: DataFrame, serial: DataFrame) -> DataFrame:
    """Both ingest paths in one log; a measure a path lacks is null."""
    return http.unionByName(serial, allowMissingColumns=True)


def decode_adc(adc: DataFrame) -> DataFrame:
    """Raw converter counts and echo times as physical measures.

    A climate sensor that fails on either measure reads 0 on both.
    """
    failed = F.isnan("humidity") | F.isnan("temperature")
    tds_volts = units.adc_to_volts(F.col("tds_adc"))
    ph_volts = units.adc_to_volts(F.col("ph_adc"))
    return adc.select(
        *ARRIVAL,
        F.when(failed, 0.0).otherwise(F.col("temperature")).alias("temperature"),
        F.when(failed, 0.0).otherwise(F.col("humidity")).alias("humidity"),
        units.echo_to_cm(F.col("echo_us")).alias("distance"),
        units.volts_to_ph(ph_volts).alias("ph"),
        units.volts_to_tds_ppm(tds_volts).alias("tds_ppm"),
    )


def encode_json(decoded: DataFrame) -> DataFrame:
    """Decoded measures as the payload a device sends, two decimals each."""
    value = {
        name: F.col(name) if name == "distance" else F.col(name).cast("decimal(18,2)")
        for name in C.DEVICE_KEYS
    }
    body = F.struct(*[value[name].alias(key) for name, key in C.DEVICE_KEYS.items()])
    return decoded.select(*ARRIVAL, F.to_json(body).alias("payload"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored reading log, all values as text."""
    return read_table(spark, path, schemas.READING_LOG)

