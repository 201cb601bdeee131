"""Schemas of the tables the operators read and write."""

READINGS_RAW = "device_id bigint, seq bigint, ts timestamp, source string, payload string"

READING_LOG = (
    "device_id bigint, seq bigint, stream_id string, temperature string, humidity string, "
    "ph string, conductivity string, distance string, timestamp string"
)

READINGS = (
    "device_id bigint, seq bigint, ts timestamp, source string, temperature double, "
    "humidity double, distance double, water_level double, conductivity double, "
    "raw_ph double, ph double"
)

ADC_RAW = (
    "device_id bigint, seq bigint, ts timestamp, tds_adc int, ph_adc int, echo_us bigint, "
    "temperature double, humidity double"
)

CONFIG_LOG = (
    "device_id bigint, seq bigint, ts timestamp, circ int, nutri int, auto int, circ_auto int"
)

CALIBRATION_LOG = (
    "device_id bigint, seq bigint, ts timestamp, op string, voltage double, ph double"
)

KV_LOG = "key string, seq bigint, ts timestamp, op string, value string, expire_s bigint"

ALERTS = "device_id bigint, ts timestamp, type string, message string"

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
