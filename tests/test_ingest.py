"""Payloads: key choice, defaults, refusals, event time, text files."""

import json

import pytest
from pyspark.sql import functions as F

from hydrolens.functions import payload as P
from hydrolens.sources import readings as source
from tests.helpers import at, rows, seconds

RAW = "device_id bigint, seq bigint, ts timestamp, payload string"


def raw(spark, *payloads):
    return spark.createDataFrame([(1, i, at(i), text) for i, text in enumerate(payloads)], RAW)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("12.5", 12.5), (" 1e3 ", 1000.0), ("-.5", -0.5), ("7.", 7.0), ("+3", 3.0),
        ("inf", float("inf")), ("12d", None), ("1.5f", None), ("0x10", None), ("abc", None),
        ("", None), (None, None), ("1 2", None),
    ],
)
def test_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(P.number(F.col("t")).alias("x")).first()["x"] == expected


def test_key_presence_decides_not_its_value(spark):
    df = raw(spark, '{"temperatura": null, "temperature": 20}', '{"temperature": 20}')
    assert rows(source.http_readings(df), "seq", "temperature") == [(1, 20.0)]
    assert rows(source.rejects(df), "seq", "reason") == [(0, "null value")]


def test_absent_keys_read_zero_or_stay_absent(spark):
    df = raw(spark, "{}")
    zero = source.http_readings(df).first()
    assert (zero["distance"], zero["water_level"], zero["raw_ph"]) == (0.0, 10.0, 0.0)
    assert zero["ph"] == pytest.approx(-39.01 * (2.5 + 7 * 0.18) + 68.48)
    absent = source.http_readings(df, missing="null").first()
    assert (absent["distance"], absent["water_level"], absent["ph"]) == (None, None, None)


@pytest.mark.parametrize("text", ["{broken", "[1]", "12", "", "null", '{"ph": 7}{', '{"ph":7},{"ph":7}'])
def test_no_object_is_refused_on_both_paths(spark, text):
    df = raw(spark, text)
    for path, read in (("http", source.http_readings), ("serial", source.serial_readings)):
        assert read(df).count() == 0
        assert rows(source.rejects(df, path), "reason") == [("malformed",)]


def test_one_bad_number_refuses_the_whole_line(spark):
    df = raw(spark, '{"ph": 7, "umidade": "wet"}', "{}", '{"pump": 1}', '{"ph": 2.5}')
    assert rows(source.serial_readings(df), "seq", "ph") == [(3, pytest.approx(2.5))]
    assert rows(source.rejects(df, "serial"), "seq", "reason") == [
        (0, "bad number"), (1, "empty"), (2, "empty"),
    ]


def test_serial_spellings_and_fallbacks(spark):
    df = raw(
        spark,
        '{"pH": 4.3, "salinity": 9, "conductivity": 5, "distance": 3}',
        '{"eletrocondutividade": 8, "distancia": 3}',
    )
    first, second = source.serial_readings(df).orderBy("seq").collect()
    assert first["ph"] == pytest.approx(8.00008)
    assert (first["salinity"], first["conductivity"], first["distance"]) == (9.0, 5.0, None)
    assert (second["salinity"], second["conductivity"], second["distance"]) == (8.0, 8.0, 3.0)


def test_event_time_is_the_payload_s_or_the_arrival(spark):
    df = raw(spark, '{"ph": 7, "timestamp": 1735689600123}', '{"ph": 7}')
    found = [seconds(row["ts"]) for row in source.serial_readings(df).orderBy("seq").collect()]
    assert found == [0.123, 1.0]


def test_taken_and_refused_are_all_payloads(spark):
    texts = ["{}", "{x", '{"ph": "a"}', '{"ph": 7}', '{"umidade": null}', "[]", '{"pH": 1}']
    df = raw(spark, *texts)
    for path, read in (("http", source.http_readings), ("serial", source.serial_readings)):
        taken, refused = rows(read(df), "seq"), rows(source.rejects(df, path), "seq")
        assert sorted(taken + refused) == [(i,) for i in range(len(texts))]


def test_union_leaves_lacking_measures_null(spark):
    df = raw(spark, '{"ph": 7, "temperatura": 20}')
    both = source.unified(source.http_readings(df), source.serial_readings(df))
    assert rows(both, "source", "salinity", "water_level") == [
        ("http", None, 10.0), ("serial", None, None),
    ]


def test_device_payload_is_read_back(spark):
    adc = spark.createDataFrame(
        [(1, 1, at(0), 2000, 2500, 588, 21.456, 55.0)],
        "device_id bigint, seq bigint, ts timestamp, tds_adc int, ph_adc int, echo_us bigint, "
        "temperature double, humidity double",
    )
    sent = source.encode_json(source.decode_adc(adc))
    body = json.loads(sent.first()["payload"])
    assert list(body) == ["temperatura", "umidade", "distancia", "ph", "eletrocondutividade"]
    assert body["temperatura"] == 21.46 and body["distancia"] == 9
    back = source.http_readings(sent).first()
    assert (back["temperature"], back["raw_ph"]) == (21.46, body["ph"])


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"ph": 1}\n\n  {broken  \n{"ph": 2}\n')
    found = rows(source.read_lines(spark, str(tmp_path)))
    assert found == [('{"ph": 1}',), ('{"ph": 2}',), ("{broken",)]
    assert source.read_lines(spark, str(tmp_path), streaming=True).isStreaming


def test_bytes_become_text(spark):
    df = spark.createDataFrame([(bytearray("Nível", "utf-8"),)], "b binary")
    assert df.select(P.decode_text(F.col("b")).alias("x")).first()["x"] == "Nível"
