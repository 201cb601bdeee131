"""The registered queries as SQL for DuckDB, written independently of Spark.

Only the text of the input payloads is shared: ``payload_sql`` makes it for both.

``log_of(...)`` style fragments below are common table expressions over the
``events`` table; each query names the ones it needs.
"""

from __future__ import annotations

from hydrolens.sources.events_views import payload_sql


def _live(at: str) -> str:
    """Live keys at a time, of the log ``kv``."""
    return f"""
  SELECT key, value, ts, expire_s FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC, op DESC,
                                 value DESC NULLS LAST, expire_s DESC NULLS LAST) AS rn
    FROM kv WHERE ts <= {at})
  WHERE rn = 1 AND op = 'set' AND (coalesce(expire_s, 0) = 0 OR ts + to_seconds(expire_s) > {at})"""


_CTE = {
    "e": """
  SELECT user_id AS device_id, event_id AS seq, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events""",
    "readings": """
  SELECT device_id, seq, ts, event_type,
         value % 75 - 12 AS temperature,
         30.0::DOUBLE + k % 60 AS humidity,
         (k % 25)::DOUBLE AS distance,
         round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, 11.0::DOUBLE - (k % 25)::DOUBLE / 2.0::DOUBLE)), 2)
           AS water_level,
         round((value * 3) * 1000 / 500.0::DOUBLE, 2) AS conductivity,
         11 + (value % 25) / 10 AS raw_ph,
         -39.01::DOUBLE * (2.5::DOUBLE - ((11 + (value % 25) / 10) - 7.0::DOUBLE) * 0.18::DOUBLE)
           + 68.48::DOUBLE AS ph
  FROM e""",
    "config_log": """
  SELECT device_id, seq, ts, CAST(k % 2 AS INTEGER) AS circ, 0 AS nutri,
         CAST(k % 3 > 0 AS INTEGER) AS auto, CAST(k % 5 > 0 AS INTEGER) AS circ_auto
  FROM e WHERE event_type = 'signup'""",
    "calibration_log": """
  SELECT device_id, seq, ts, CASE WHEN k % 20 = 0 THEN 'reset' ELSE 'add' END AS op,
         CASE WHEN k % 20 <> 0 THEN 1.0::DOUBLE + k / 100.0::DOUBLE END AS voltage,
         CASE WHEN k % 20 <> 0 THEN (4 + k % 7)::DOUBLE END AS ph
  FROM e WHERE event_type = 'purchase'""",
    "points": """
  SELECT device_id, voltage, arg_max(ph, seq) AS ph
  FROM calibration_log c
  WHERE op = 'add' AND seq > coalesce(
    (SELECT max(seq) FROM calibration_log r WHERE r.device_id = c.device_id AND r.op = 'reset'), -1)
  GROUP BY device_id, voltage""",
    "lines": """
  SELECT device_id, count(*) AS points_count, min(voltage) AS v1, max(voltage) AS v2,
         arg_min(ph, voltage) AS p1, arg_max(ph, voltage) AS p2
  FROM points GROUP BY device_id""",
    "fitted": """
  SELECT device_id, points_count, slope, p1 - slope * v1 AS intercept
  FROM (SELECT *, CASE WHEN v1 = v2 THEN -5.5555::DOUBLE ELSE (p2 - p1) / (v2 - v1) END AS slope
        FROM lines)""",
    "kv": """
  SELECT CASE WHEN seq % 101 <> 0 THEN event_type || ':' || CAST(k AS VARCHAR) END AS key, seq,
         CASE WHEN seq % 13 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END AS ts,
         CASE WHEN seq % 11 = 0 THEN 'delete' ELSE 'set' END AS op,
         CASE WHEN seq % 11 <> 0 THEN CAST(seq AS VARCHAR) || CASE WHEN seq % 19 = 0 AND copy = 1 THEN 'b' ELSE '' END
         END AS value,
         CASE WHEN seq % 11 <> 0 AND seq % 7 = 0 THEN 86400::BIGINT END AS expire_s
  FROM e, (VALUES (0), (1)) AS copies(copy) WHERE copy = 0 OR seq % 17 = 0 OR seq % 19 = 0""",
    "live": _live("TIMESTAMP '2024-01-30 12:00:00'"),
    "adc": """
  SELECT device_id, seq, ts, CAST(seq * 37 % 4096 AS INTEGER) AS tds_adc,
         CAST(seq * 101 % 4096 AS INTEGER) AS ph_adc, 100 + k * 15 AS echo_us,
         value % 75 - 12 AS t0,
         CASE WHEN k % 10 = 0 THEN 'nan'::DOUBLE ELSE 30.0::DOUBLE + k % 60 END AS h0
  FROM e""",
    "volts": """
  SELECT *, tds_adc * (3.3::DOUBLE / 4095.0::DOUBLE) AS v, ph_adc * (3.3::DOUBLE / 4095.0::DOUBLE) AS w
  FROM adc""",
    "decoded": """
  SELECT device_id, seq, ts,
         CASE WHEN isnan(h0) OR isnan(t0) THEN 0.0::DOUBLE ELSE t0 END AS temperature,
         CASE WHEN isnan(h0) OR isnan(t0) THEN 0.0::DOUBLE ELSE h0 END AS humidity,
         CAST(trunc(echo_us * 0.034::DOUBLE / 2) AS BIGINT) AS distance,
         7.0::DOUBLE + (2.5::DOUBLE - w) / 0.18::DOUBLE AS ph,
         (133.42::DOUBLE * v * v * v + -255.86::DOUBLE * v * v + 857.39::DOUBLE * v) * 0.5::DOUBLE
           AS tds_ppm
  FROM volts""",
    "raw": f"""
  SELECT device_id, seq, ts, CASE WHEN seq % 3 = 0 THEN 'serial' ELSE 'http' END AS source,
         {payload_sql("VARCHAR")} AS payload
  FROM e""",
    "parsed": """
  SELECT *, CASE WHEN ok THEN json_keys(body) END AS names
  FROM (SELECT *, ok0 AND json_type(body0) = 'OBJECT' AS ok,
               CASE WHEN ok0 AND json_type(body0) = 'OBJECT' THEN body0 END AS body
        FROM (SELECT *, json_valid(payload) AS ok0,
                     CASE WHEN json_valid(payload) THEN payload::JSON END AS body0,
                     regexp_extract_all(payload, '"ph": ([^,}]+)', 1) AS phs FROM raw))""",
    "http_fields": """
  SELECT *,
    CASE WHEN list_contains(names, 'eletrocondutividade') THEN body->>'$.eletrocondutividade'
         WHEN list_contains(names, 'conductivity') THEN body->>'$.conductivity' ELSE '0' END AS x_ec,
    CASE WHEN list_contains(names, 'distancia') THEN body->>'$.distancia'
         WHEN list_contains(names, 'distance') THEN body->>'$.distance' ELSE '0' END AS x_d,
    CASE WHEN list_contains(names, 'temperatura') THEN body->>'$.temperatura'
         WHEN list_contains(names, 'temperature') THEN body->>'$.temperature' ELSE '0' END AS x_t,
    CASE WHEN list_contains(names, 'umidade') THEN body->>'$.umidade'
         WHEN list_contains(names, 'humidity') THEN body->>'$.humidity' ELSE '0' END AS x_h,
    CASE WHEN len(phs) > 1 THEN phs[len(phs)]
         WHEN list_contains(names, 'ph') THEN body->>'$.ph' ELSE '0' END AS x_ph
  FROM parsed""",
    "http_judged": """
  SELECT *, CASE WHEN NOT coalesce(ok, FALSE) THEN 'malformed'
    WHEN TRY_CAST(x_ec AS DOUBLE) IS NULL OR TRY_CAST(x_d AS DOUBLE) IS NULL
      OR TRY_CAST(x_ph AS DOUBLE) IS NULL THEN 'bad number'
    WHEN x_t IS NULL OR x_h IS NULL THEN 'null value' END AS reason
  FROM http_fields""",
    "http": """
  SELECT device_id, seq, ts, 'http' AS source,
         TRY_CAST(x_t AS DOUBLE) AS temperature, TRY_CAST(x_h AS DOUBLE) AS humidity,
         TRY_CAST(x_d AS DOUBLE) AS distance,
         round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, 11.0::DOUBLE - x_d::DOUBLE / 2.0::DOUBLE)), 2)
           AS water_level,
         round(x_ec::DOUBLE * 1000 / 500.0::DOUBLE, 2) AS conductivity,
         x_ph::DOUBLE AS raw_ph,
         -39.01::DOUBLE * (2.5::DOUBLE - (x_ph::DOUBLE - 7.0::DOUBLE) * 0.18::DOUBLE)
           + 68.48::DOUBLE AS ph
  FROM http_judged WHERE reason IS NULL{only_http}""",
    "serial_fields": """
  SELECT *,
    CASE WHEN len(phs) > 1 THEN phs[len(phs)]
         WHEN list_contains(names, 'ph') THEN body->>'$.ph' ELSE body->>'$.pH' END AS x_ph,
    list_contains(names, 'ph') OR list_contains(names, 'pH') AS has_ph,
    CASE WHEN list_contains(names, 'temperatura') THEN body->>'$.temperatura'
         ELSE body->>'$.temperature' END AS x_t,
    list_contains(names, 'temperatura') OR list_contains(names, 'temperature') AS has_t,
    CASE WHEN list_contains(names, 'umidade') THEN body->>'$.umidade'
         ELSE body->>'$.humidity' END AS x_h,
    list_contains(names, 'umidade') OR list_contains(names, 'humidity') AS has_h,
    CASE WHEN list_contains(names, 'salinidade') THEN body->>'$.salinidade'
         WHEN list_contains(names, 'salinity') THEN body->>'$.salinity'
         ELSE body->>'$.eletrocondutividade' END AS x_s,
    list_contains(names, 'salinidade') OR list_contains(names, 'salinity')
      OR list_contains(names, 'eletrocondutividade') AS has_s,
    CASE WHEN list_contains(names, 'eletrocondutividade') THEN body->>'$.eletrocondutividade'
         ELSE body->>'$.conductivity' END AS x_ec,
    list_contains(names, 'eletrocondutividade') OR list_contains(names, 'conductivity') AS has_ec,
    body->>'$.distancia' AS x_d, list_contains(names, 'distancia') AS has_d,
    body->>'$.timestamp' AS x_ts, list_contains(names, 'timestamp') AS has_ts
  FROM parsed""",
    "serial_judged": """
  SELECT *, CASE WHEN NOT coalesce(ok, FALSE) THEN 'malformed'
    WHEN NOT (has_ph OR has_t OR has_h OR has_s OR has_ec OR has_d OR has_ts) THEN 'empty'
    WHEN (has_ph AND TRY_CAST(x_ph AS DOUBLE) IS NULL) OR (has_t AND TRY_CAST(x_t AS DOUBLE) IS NULL)
      OR (has_h AND TRY_CAST(x_h AS DOUBLE) IS NULL) OR (has_s AND TRY_CAST(x_s AS DOUBLE) IS NULL)
      OR (has_ec AND TRY_CAST(x_ec AS DOUBLE) IS NULL) OR (has_d AND TRY_CAST(x_d AS DOUBLE) IS NULL)
      THEN 'bad number'
    WHEN has_ts AND x_ts IS NOT NULL AND NOT coalesce(TRY_CAST(x_ts AS DOUBLE)
      BETWEEN -62135596800000 AND 253402300799999, FALSE) THEN 'bad time' END AS reason
  FROM serial_fields""",
    "serial": """
  SELECT device_id, seq,
         coalesce(make_timestamp(TRY_CAST(x_ts AS BIGINT) * 1000), ts) AS ts, 'serial' AS source,
         x_t::DOUBLE AS temperature, x_h::DOUBLE AS humidity, x_d::DOUBLE AS distance,
         x_ec::DOUBLE AS conductivity, x_s::DOUBLE AS salinity,
         x_ph::DOUBLE * 3.0556::DOUBLE + -5.139::DOUBLE AS ph
  FROM serial_judged WHERE reason IS NULL{only_serial}""",
    "either": """
  SELECT device_id, seq, ts, source, temperature, humidity, distance, water_level, conductivity,
         raw_ph, ph, NULL::DOUBLE AS salinity FROM http
  UNION ALL
  SELECT device_id, seq, ts, source, temperature, humidity, distance, NULL, conductivity,
         NULL, ph, salinity FROM serial""",
    "stored": """
  SELECT device_id, seq, epoch_us(ts) // 1000 AS ms,
         CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS stream_id,
         CASE WHEN seq % 29 <> 0 THEN CAST(value % 75 - 12 AS DECIMAL(12,2))::DOUBLE END AS temperature,
         (30 + k % 60)::DOUBLE AS humidity,
         CASE WHEN seq % 61 = 0 THEN 1e30::DOUBLE WHEN seq % 67 = 0 THEN 'nan'::DOUBLE
              WHEN seq % 31 <> 0 THEN CAST(value % 15 AS DECIMAL(12,2))::DOUBLE END AS ph,
         CAST(value * 6 AS DECIMAL(12,2))::DOUBLE AS conductivity,
         (k % 25)::DOUBLE AS distance
  FROM e WHERE seq % 23 <> 0 AND seq % 37 <> 0 AND seq % 41 <> 0 AND seq % 43 <> 0
    AND seq % 47 <> 0 AND seq % 53 <> 0""",
    "cleaned": """
  SELECT device_id, seq, stream_id, ms AS arrival_ms, make_timestamp(ms * 1000) AS ts, temperature, humidity,
         ph, conductivity, distance
  FROM stored""",
    "smoothed": """
  SELECT device_id, seq, ts, round(avg(conductivity) OVER (
           PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 2) AS ec
  FROM readings WHERE event_type <> 'signup'""",
    "happened": """
  SELECT device_id, epoch_us(ts) AS us, ts, seq, 2 AS kind, ec < 310.0 AS low,
         0 AS circ, 0 AS auto, 0 AS circ_auto
  FROM smoothed
  UNION ALL
  SELECT device_id, epoch_us(ts), ts, seq, 1, FALSE, circ, auto, circ_auto FROM config_log""",
    "numbered": """
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY us, kind, seq) AS n FROM happened""",
    # One step per event: the state before it with the due switch-off applied,
    # then what the event does to it.
    "walk": """
  SELECT device_id, 0::BIGINT AS n, 0 AS circ, 0 AS auto, 0 AS circ_auto, NULL::BIGINT AS off_at,
         NULL::BIGINT AS last_dose, NULL::BIGINT AS last_cycle, NULL::VARCHAR AS nutri_action,
         FALSE AS cycled, 0::BIGINT AS wait_us
  FROM (SELECT DISTINCT device_id FROM numbered)
  UNION ALL
  SELECT device_id, n,
         CASE WHEN kind = 1 THEN w_circ WHEN nutri_action = 'force_circ' OR cycled THEN 1 ELSE circ END,
         CASE WHEN kind = 1 THEN w_auto ELSE auto END,
         CASE WHEN kind = 1 THEN w_circ_auto ELSE circ_auto END,
         CASE WHEN cycled THEN us + 18000000000
              + CASE WHEN nutri_action = 'dose' THEN 3600000000 ELSE 0 END ELSE off_at END,
         CASE WHEN nutri_action = 'dose' THEN us ELSE last_dose END,
         CASE WHEN cycled THEN us ELSE last_cycle END,
         nutri_action, cycled,
         CASE WHEN nutri_action = 'skip' THEN 21600000000 - (us - last_dose) ELSE 0 END
  FROM (
    SELECT *,
      CASE WHEN kind = 2 AND auto = 1 AND low THEN
        CASE WHEN circ = 0 THEN 'force_circ'
             WHEN last_dose IS NOT NULL AND us - last_dose < 21600000000 THEN 'skip'
             ELSE 'dose' END END AS nutri_action,
      kind = 2 AND circ_auto = 1 AND (last_cycle IS NULL OR us - last_cycle > 43200000000) AS cycled
    FROM (
      SELECT x.device_id, x.n, x.us, x.kind, x.low,
             x.circ AS w_circ, x.auto AS w_auto, x.circ_auto AS w_circ_auto,
             CASE WHEN w.off_at <= x.us THEN 0 ELSE w.circ END AS circ,
             CASE WHEN w.off_at <= x.us THEN NULL ELSE w.off_at END AS off_at,
             w.auto, w.circ_auto, w.last_dose, w.last_cycle
      FROM walk w JOIN numbered x ON x.device_id = w.device_id AND x.n = w.n + 1))""",
    "acted": """
  SELECT x.device_id, x.seq, x.ts, w.nutri_action AS action,
         CASE WHEN w.nutri_action = 'dose' THEN make_timestamp(x.us + 3600000000) END AS off_ts,
         w.wait_us
  FROM walk w JOIN numbered x USING (device_id, n) WHERE w.nutri_action IS NOT NULL
  UNION ALL
  SELECT x.device_id, x.seq, x.ts, 'cycle', make_timestamp(w.off_at), 0::BIGINT
  FROM walk w JOIN numbered x USING (device_id, n) WHERE w.cycled""",
    "changes": """
  SELECT device_id, seq, ts, 1 AS kind, 'circ' AS pump, circ AS state FROM config_log
  UNION ALL SELECT device_id, seq, ts, 1, 'nutri', nutri FROM config_log
  UNION ALL SELECT device_id, seq, ts, 2, CASE WHEN action = 'dose' THEN 'nutri' ELSE 'circ' END, 1
            FROM acted WHERE action <> 'skip'
  UNION ALL SELECT device_id, seq, off_ts, 0, CASE WHEN action = 'dose' THEN 'nutri' ELSE 'circ' END, 0
            FROM acted WHERE off_ts IS NOT NULL""",
    "timeline": """
  SELECT *, lead(ts) OVER (PARTITION BY device_id, pump ORDER BY ts, kind, seq) AS until
  FROM changes""",
    "on_spans": """
  SELECT device_id, pump, ts AS a, coalesce(until, TIMESTAMP '2024-02-01') AS b
  FROM timeline WHERE state = 1 AND coalesce(until, TIMESTAMP '2024-02-01') > ts""",
    "on_hours": """
  SELECT *, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR))
    AS hour FROM on_spans""",
    "walked_log": """
  SELECT *, sum(CASE WHEN op = 'reset' THEN 1 ELSE 0 END) OVER (
    PARTITION BY device_id ORDER BY ts, seq) AS stretch
  FROM calibration_log""",
    "log_ends": """
  SELECT l.device_id, l.seq, l.ts, min(p.voltage) AS v1, max(p.voltage) AS v2,
         arg_min(p.ph, p.voltage * 1000000000 - p.seq) AS p1,
         arg_max(p.ph, p.voltage * 1000000000 + p.seq) AS p2
  FROM walked_log l LEFT JOIN walked_log p
    ON p.device_id = l.device_id AND p.stretch = l.stretch AND p.seq <= l.seq AND p.op = 'add'
  GROUP BY l.device_id, l.seq, l.ts""",
    "log_lines": """
  SELECT device_id, seq, ts, slope, p1 - slope * v1 AS intercept
  FROM (SELECT *, CASE WHEN v1 = v2 THEN -5.5555::DOUBLE ELSE (p2 - p1) / (v2 - v1) END AS slope
        FROM log_ends)""",
    "summary": """
  SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS position,
         'T=' || CAST(CAST(temperature AS DECIMAL(18,2)) AS VARCHAR) || 'C, pH='
         || CAST(CAST(ph AS DECIMAL(18,2)) AS VARCHAR) || ', EC='
         || CAST(CAST(conductivity AS DECIMAL(18,2)) AS VARCHAR) || ', Nível='
         || CAST(CAST(water_level AS DECIMAL(18,2)) AS VARCHAR) || 'L' AS line
  FROM readings""",
}

_READING_CTES = "e readings"
_HTTP = "e raw parsed http_fields http_judged http"
_SERIAL = "e raw parsed serial_fields serial_judged serial"
_BOTH = _HTTP + " serial_fields serial_judged serial either"
_WALK = "e readings config_log smoothed happened numbered walk acted"
_POINTS = "e calibration_log points"
_READING = (
    "device_id, seq, ts, temperature, humidity, distance, water_level, conductivity, raw_ph, ph"
)
_PLAUSIBLE = "ph >= 0 AND ph <= 14 AND temperature > -10 AND temperature < 60"
_KPIS = """round(avg(temperature), 6) AS avg_temp, max(temperature) AS max_temp,
  min(temperature) AS min_temp, round(avg(ph), 6) AS avg_ph,
  round(avg(humidity), 6) AS avg_humidity, round(stddev_samp(temperature), 6) AS stddev_temp"""
_HOUR = "date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end"
_LAST10 = "OVER (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_MEASURES = ("ph", "temperature", "humidity", "conductivity", "distance", "water_level")


def _sql(ctes: str, body: str, both: bool = False) -> str:
    """``WITH`` the named tables; ``both`` splits payloads by their source."""
    parts = []
    for name in ctes.split():
        text = _CTE[name]
        if name == "http":
            text = text.replace("{only_http}", " AND source = 'http'" if both else "")
        if name == "serial":
            text = text.replace("{only_serial}", " AND source = 'serial'" if both else "")
        parts.append(f"{name} AS ({text})")
    recursive = "RECURSIVE " if "walk" in ctes.split() else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


def _stale(name: str) -> str:
    return f"CASE WHEN age > 43200000000 THEN 0.0::DOUBLE ELSE {name} END AS {name}"


_GAPS = """SELECT device_id, seq, ts, lag(ts) OVER w AS previous_ts,
  epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us
  FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)"""
_MA_PH = f"SELECT device_id, seq, ts, ph, round(avg(ph) {_LAST10}, 6) AS ph_ma10 FROM readings"
_MA_EC = (
    "SELECT device_id, seq, ts, conductivity, "
    f"round(avg(conductivity) {_LAST10}, 6) AS conductivity_ma10 FROM readings"
)
_CONFIG_AS_OF = """SELECT r.device_id, r.seq, r.ts, r.conductivity, coalesce(c.circ, 0) AS circ,
  coalesce(c.nutri, 0) AS nutri, coalesce(c.auto, 0) AS auto, coalesce(c.circ_auto, 0) AS circ_auto
  FROM readings r ASOF LEFT JOIN config_log c ON r.device_id = c.device_id AND r.ts >= c.ts
  WHERE r.event_type <> 'signup'"""
_CALIBRATED_AS_OF = """SELECT r.device_id, r.seq, r.ts, r.raw_ph,
  CASE WHEN l.slope IS NULL THEN r.raw_ph
       ELSE l.slope * (2.5::DOUBLE - (r.raw_ph - 7.0::DOUBLE) * 0.18::DOUBLE) + l.intercept END
    AS calibrated_ph
  FROM readings r ASOF LEFT JOIN log_lines l ON r.device_id = l.device_id AND r.ts >= l.ts
  WHERE r.event_type <> 'purchase'"""
_OFFLINE = """SELECT device_id, ts + INTERVAL 24 HOUR AS offline_from, next_ts AS offline_until
  FROM (SELECT device_id, ts, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS next_ts
        FROM readings)
  WHERE coalesce(next_ts, TIMESTAMP '2024-01-30 12:00:00') - ts > INTERVAL 24 HOUR"""
_ALERTS = """SELECT device_id, seq, ts, 'CRITICAL' AS type,
  'pH fora da faixa ideal: ' || CAST(CAST(ph AS DECIMAL(18,2)) AS VARCHAR) AS message,
  epoch_us(ts) // 1000 AS timestamp FROM readings WHERE ph < 5.8 OR ph > 6.8"""
_ACTIONS = "SELECT device_id, seq, ts, action, off_ts, wait_us FROM acted"
_TIMELINE = "SELECT device_id, seq, ts, kind, pump, state, until FROM timeline"
_HOURLY = f"SELECT {_HOUR}, {_KPIS} FROM readings WHERE {_PLAUSIBLE} GROUP BY date_trunc('hour', ts)"
_LOG_LINES = "e readings calibration_log walked_log log_ends log_lines"

ORACLE: dict[str, str] = {
    "latest_n": _sql(
        _READING_CTES, f"SELECT {_READING} FROM readings ORDER BY ts DESC, seq DESC LIMIT 1000"
    ),
    "history_n": _sql(
        _READING_CTES,
        f"""SELECT {_READING}, position, epoch_us(ts) // 1000 AS timestamp_ms,
  CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS id
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS INTEGER)
          AS position FROM readings)
  WHERE position <= 50""",
    ),
    "unified_readings": _sql(_BOTH, "SELECT * FROM either", both=True),
    "latest_state": _sql(
        _BOTH,
        "SELECT device_id, arg_max(ts, seq) AS ts, "
        + ", ".join(
            f"arg_max({name}, seq) FILTER (WHERE {name} IS NOT NULL) AS {name}"
            for name in (*_MEASURES, "raw_ph", "salinity")
        )
        + " FROM either GROUP BY device_id",
        both=True,
    ),
    "device_status": _sql(
        _READING_CTES,
        "SELECT device_id, ts, "
        + ", ".join(_stale(name) for name in _MEASURES)
        + """, CASE WHEN age > 43200000000 THEN 'offline' ELSE 'online' END AS status
  FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts) AS age,
               row_number() OVER (PARTITION BY device_id ORDER BY seq DESC) AS rn FROM readings)
  WHERE rn = 1""",
    ),
    "temp_ranking": _sql(
        _READING_CTES,
        """SELECT device_id, 'reading:' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS id,
  arg_max(temperature, seq) AS temperature FROM readings GROUP BY device_id, epoch_us(ts) // 1000
  ORDER BY temperature DESC, id DESC, device_id DESC LIMIT 10""",
    ),
    "temp_ranking_by_device": _sql(
        _READING_CTES,
        """SELECT device_id, id, temperature, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY temperature DESC, id DESC)
    AS INTEGER) AS position
  FROM (SELECT device_id, 'reading:' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS id,
               arg_max(temperature, seq) AS temperature
        FROM readings GROUP BY device_id, epoch_us(ts) // 1000))
  WHERE position <= 10""",
    ),
    "reading_gaps": _sql(_READING_CTES, _GAPS),
    "ingest_json": _sql(_HTTP, "SELECT * FROM http"),
    "ingest_json_sparse": _sql(
        _HTTP,
        """SELECT h.device_id, h.seq, h.ts, h.source,
  CASE WHEN list_has_any(j.names, ['temperatura', 'temperature']) THEN h.temperature END AS temperature,
  CASE WHEN list_has_any(j.names, ['umidade', 'humidity']) THEN h.humidity END AS humidity,
  CASE WHEN list_has_any(j.names, ['distancia', 'distance']) THEN h.distance END AS distance,
  CASE WHEN list_has_any(j.names, ['distancia', 'distance']) THEN h.water_level END AS water_level,
  CASE WHEN list_has_any(j.names, ['eletrocondutividade', 'conductivity']) THEN h.conductivity END
    AS conductivity,
  CASE WHEN list_contains(j.names, 'ph') THEN h.raw_ph END AS raw_ph,
  CASE WHEN list_contains(j.names, 'ph') THEN h.ph END AS ph
  FROM http h JOIN http_judged j USING (seq)""",
    ),
    "ingest_smoothed": _sql(
        _HTTP,
        f"""SELECT device_id, seq, ts, source, temperature, humidity, distance, water_level, raw_ph,
  round(avg(ph) {_LAST10}, 6) AS ph, round(avg(conductivity) {_LAST10}, 6) AS conductivity,
  round(avg(conductivity) {_LAST10}, 6) AS eletrocondutividade FROM http""",
    ),
    "ingest_lines": _sql(_SERIAL, "SELECT * FROM serial", both=True),
    "ingest_bytes": _sql(_HTTP, "SELECT * FROM http"),
    "ingest_rejects": _sql(
        _HTTP,
        "SELECT device_id, seq, ts, payload, reason FROM http_judged WHERE reason IS NOT NULL",
    ),
    "normalize_serial": _sql(_SERIAL, "SELECT * FROM serial"),
    "serial_rejects": _sql(
        _SERIAL,
        "SELECT device_id, seq, ts, payload, reason FROM serial_judged WHERE reason IS NOT NULL",
    ),
    "encode_json": _sql(
        "e adc volts decoded",
        """SELECT device_id, seq, ts,
  '{"temperatura":' || CAST(CAST(temperature AS DECIMAL(18,2)) AS VARCHAR)
  || ',"umidade":' || CAST(CAST(humidity AS DECIMAL(18,2)) AS VARCHAR)
  || ',"distancia":' || CAST(distance AS VARCHAR)
  || ',"ph":' || CAST(CAST(ph AS DECIMAL(18,2)) AS VARCHAR)
  || ',"eletrocondutividade":' || CAST(CAST(tds_ppm AS DECIMAL(18,2)) AS VARCHAR) || '}' AS payload
  FROM decoded""",
    ),
    "decode_adc": _sql("e adc volts decoded", "SELECT * FROM decoded"),
    "ph_voltage": _sql(
        _READING_CTES,
        "SELECT device_id, seq, raw_ph, 2.5::DOUBLE - (raw_ph - 7.0::DOUBLE) * 0.18::DOUBLE AS voltage "
        "FROM readings",
    ),
    "ph_ingest_cal": _sql(_READING_CTES, "SELECT device_id, seq, raw_ph, ph FROM readings"),
    "ec_convert": _sql(_READING_CTES, "SELECT device_id, seq, conductivity FROM readings"),
    "water_level": _sql(_READING_CTES, "SELECT device_id, seq, distance, water_level FROM readings"),
    "clean_readings": _sql("e stored cleaned", "SELECT * FROM cleaned"),
    "log_rejects": _sql(
        "e",
        """SELECT device_id, seq,
  CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS stream_id, timestamp,
  CASE WHEN timestamp IS NULL THEN 'no time' ELSE 'bad time' END AS reason
  FROM (SELECT *, CASE WHEN seq % 37 = 0 THEN 'nan' WHEN seq % 41 = 0 THEN '1e18'
                       WHEN seq % 43 = 0 THEN '-inf' WHEN seq % 47 = 0 THEN 'soon'
                       WHEN seq % 53 = 0 THEN '1e30'
                       WHEN seq % 23 <> 0 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) END AS timestamp
        FROM e)
  WHERE timestamp IS NULL OR timestamp IN ('nan', '1e18', '-inf', 'soon', '1e30')""",
    ),
    "outlier_filter": _sql(_READING_CTES, f"SELECT {_READING} FROM readings WHERE {_PLAUSIBLE}"),
    "outlier_counts": _sql(
        "e stored cleaned",
        f"""SELECT count(*) AS rows_in, count(*) FILTER (WHERE {_PLAUSIBLE}) AS rows_kept,
  count(*) - count(*) FILTER (WHERE {_PLAUSIBLE}) AS outliers,
  count(*) FILTER (WHERE ph IS NULL OR temperature IS NULL) AS rows_null,
  count(*) FILTER (WHERE NOT ({_PLAUSIBLE}) AND ph IS NOT NULL AND temperature IS NOT NULL)
    AS rows_out_of_range
  FROM cleaned""",
    ),
    "range_status": _sql(
        _READING_CTES,
        f"""SELECT {_READING},
  CASE WHEN ph < 5.5 THEN 'low' WHEN ph > 6.5 THEN 'high' ELSE 'ok' END AS ph_status,
  CASE WHEN temperature < 18 THEN 'low' WHEN temperature > 28 THEN 'high' ELSE 'ok' END
    AS temperature_status,
  CASE WHEN conductivity < 800 THEN 'low' WHEN conductivity > 1500 THEN 'high' ELSE 'ok' END
    AS conductivity_status,
  CASE WHEN water_level > 10 THEN 'high' ELSE 'ok' END AS water_level_status
  FROM readings""",
    ),
    "hourly_kpis": _sql(_READING_CTES, _HOURLY),
    "hourly_kpis_merged": _sql(_READING_CTES, _HOURLY),
    "hourly_kpis_by_device": _sql(
        _READING_CTES,
        f"SELECT device_id, {_HOUR}, {_KPIS} FROM readings WHERE {_PLAUSIBLE} "
        "GROUP BY device_id, date_trunc('hour', ts)",
    ),
    "kpi_keyed": _sql(
        _READING_CTES,
        f"SELECT 'kpi:' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS kpi_key, {_HOUR}, {_KPIS} "
        f"FROM readings WHERE {_PLAUSIBLE} GROUP BY date_trunc('hour', ts)",
    ),
    "log_kpis": _sql(
        "e stored cleaned",
        f"SELECT {_HOUR}, {_KPIS} FROM cleaned WHERE {_PLAUSIBLE} GROUP BY date_trunc('hour', ts)",
    ),
    "kpi_job": _sql(
        "e stored cleaned",
        f"SELECT 'kpi:' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS kpi_key, {_HOUR}, {_KPIS} "
        f"FROM cleaned WHERE {_PLAUSIBLE} GROUP BY date_trunc('hour', ts)",
    ),
    "ph_ma10": _sql(_READING_CTES, _MA_PH),
    "ec_ma10": _sql(_READING_CTES, _MA_EC),
    "calibration_points": _sql(_POINTS, "SELECT device_id, voltage, ph FROM points"),
    "calibration_requests": _sql(
        _READING_CTES,
        """SELECT q.device_id, q.seq, q.ts, 'add' AS op,
  2.5::DOUBLE - (r.raw_ph - 7.0::DOUBLE) * 0.18::DOUBLE AS voltage, q.known_ph AS ph
  FROM (SELECT device_id, seq, ts, (4 + k % 7)::DOUBLE AS known_ph FROM e
        WHERE event_type = 'purchase') q
  ASOF JOIN (SELECT * FROM readings WHERE event_type <> 'purchase') r
    ON q.device_id = r.device_id AND q.ts >= r.ts""",
    ),
    "calibration_status": _sql(
        _POINTS,
        "SELECT device_id, count(*) AS points_count, count(*) >= 2 AS is_calibrated "
        "FROM points GROUP BY device_id",
    ),
    "calibration_report": _sql(
        _POINTS,
        """SELECT device_id, voltage, ph, count(*) OVER (PARTITION BY device_id) AS points_count,
  count(*) OVER (PARTITION BY device_id) >= 2 AS is_calibrated FROM points""",
    ),
    "calibration_line": _sql(
        _POINTS + " lines fitted", "SELECT device_id, points_count, slope, intercept FROM fitted"
    ),
    "calibrated_ph": _sql(
        "e readings calibration_log points lines fitted",
        """SELECT r.device_id, r.seq, r.ts, r.raw_ph,
  CASE WHEN f.slope IS NULL THEN r.raw_ph
       ELSE f.slope * (2.5::DOUBLE - (r.raw_ph - 7.0::DOUBLE) * 0.18::DOUBLE) + f.intercept END
    AS calibrated_ph
  FROM readings r LEFT JOIN fitted f USING (device_id)""",
    ),
    "calibrated_ph_asof": _sql(_LOG_LINES, _CALIBRATED_AS_OF),
    "config_current": _sql(
        "e config_log",
        """SELECT device_id, ts, circ, nutri, auto, circ_auto FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq DESC) AS rn FROM config_log)
  WHERE rn = 1""",
    ),
    "config_writes": _sql(
        "e",
        """SELECT device_id, seq, ts, CAST(k % 4 > 0 AND k % 2 = 1 AS INTEGER) AS circ, 0 AS nutri,
  CAST(k % 7 > 0 AND k % 3 > 0 AS INTEGER) AS auto, CAST(k % 5 > 0 AS INTEGER) AS circ_auto
  FROM e WHERE event_type = 'signup'""",
    ),
    "config_asof": _sql("e readings config_log", _CONFIG_AS_OF),
    "config_asof_nulls": _sql(
        "e readings config_log",
        """SELECT nullif(r.d, -1) AS device_id, r.seq, r.ts, r.conductivity, coalesce(c.circ, 0) AS circ,
  coalesce(c.nutri, 0) AS nutri, coalesce(c.auto, 0) AS auto, coalesce(c.circ_auto, 0) AS circ_auto
  FROM (SELECT *, CASE WHEN device_id % 7 <> 0 THEN device_id ELSE -1 END AS d FROM readings
        WHERE event_type <> 'signup') r
  ASOF LEFT JOIN (
    SELECT CASE WHEN device_id % 7 <> 0 THEN device_id ELSE -1 END AS d, ts, arg_max(circ, seq) AS circ,
           arg_max(nutri, seq) AS nutri, arg_max(auto, seq) AS auto, arg_max(circ_auto, seq) AS circ_auto
    FROM config_log GROUP BY d, ts) c ON r.d = c.d AND r.ts >= c.ts""",
    ),
    "dose_candidates": _sql(
        "e readings config_log smoothed",
        """SELECT r.device_id, r.seq, r.ts, c.circ, c.auto
  FROM smoothed r ASOF JOIN config_log c ON r.device_id = c.device_id AND r.ts >= c.ts
  WHERE c.auto = 1 AND r.ec < 310.0""",
    ),
    "dose_events": _sql(
        _WALK,
        "SELECT device_id, seq, ts, action, off_ts, wait_us / 1000000::DOUBLE AS wait_s "
        "FROM acted WHERE action IN ('dose', 'skip')",
    ),
    "circ_cycles": _sql(
        _WALK, "SELECT device_id, seq, ts, off_ts FROM acted WHERE action = 'cycle'"
    ),
    "pump_actions": _sql(_WALK, _ACTIONS),
    "last_actions": _sql(
        _WALK,
        """SELECT device_id, max(ts) FILTER (WHERE action = 'dose') AS last_dose,
  max(ts) FILTER (WHERE action = 'cycle') AS last_cycle
  FROM acted WHERE action IN ('dose', 'cycle') GROUP BY device_id""",
    ),
    "pump_timeline": _sql(_WALK + " changes timeline", _TIMELINE),
    "pump_runtime": _sql(
        _WALK + " changes timeline on_spans on_hours",
        """SELECT device_id, pump, hour, CAST(sum(least(epoch_us(b), epoch_us(hour) + 3600000000)
    - greatest(epoch_us(a), epoch_us(hour))) AS BIGINT) AS on_us
  FROM on_hours GROUP BY device_id, pump, hour
  HAVING sum(least(epoch_us(b), epoch_us(hour) + 3600000000) - greatest(epoch_us(a), epoch_us(hour))) > 0""",
    ),
    "alerts": _sql(_READING_CTES, _ALERTS),
    "alert_messages": _sql(
        _READING_CTES,
        """SELECT device_id, ts, '{"type":"CRITICAL","message":"' || message || '","timestamp":'
  || CAST(timestamp AS VARCHAR) || '}' AS value FROM ("""
        + _ALERTS
        + ")",
    ),
    "offline_spans": _sql(_READING_CTES, _OFFLINE),
    "context_report": _sql(
        "e readings summary",
        """SELECT device_id, string_agg(line, chr(10) ORDER BY position) AS history
  FROM summary WHERE position <= 10 GROUP BY device_id""",
    ),
    "kv_snapshot": _sql("e kv live", "SELECT key, value, ts, expire_s FROM live"),
    "kv_lookup": _sql(
        "e kv live",
        """SELECT k.key, l.value, l.ts IS NOT NULL AS found
  FROM (SELECT DISTINCT key FROM kv) k LEFT JOIN live l ON k.key IS NOT DISTINCT FROM l.key""",
    ),
    "kv_snapshots": _sql(
        "e kv",
        " UNION ALL ".join(
            f"SELECT {at} AS at, * FROM ({_live(at)})"
            for at in ("TIMESTAMP '2024-01-16 00:00:00'", "TIMESTAMP '2024-01-22 00:00:00'", "TIMESTAMP '2024-01-30 12:00:00'")
        ),
    ),
    "kv_list": _sql("e kv live", "SELECT key FROM live WHERE key GLOB '*i*:?[1-4]'"),
    "kv_delete": _sql(
        "e kv live",
        """SELECT * FROM live
WHERE NOT EXISTS (SELECT 1 FROM kv WHERE op = 'delete' AND kv.key IS NOT DISTINCT FROM live.key)""",
    ),
}



def _as_shipped(sql: str) -> str:
    """The rules with their own thresholds, over time that runs 360 times as fast."""
    faster = "make_timestamp((epoch_us(ts) - 1704067200000000) // 360 + 1704067200000000) AS ts"
    for scaled, own in (
        ("event_id AS seq, ts,", f"event_id AS seq, {faster},"),
        ("us + 18000000000", "us + 60000000"),
        ("THEN 3600000000 ELSE", "THEN 5000000 ELSE"),
        ("us + 3600000000", "us + 5000000"),
        ("21600000000", "60000000"),
        ("43200000000", "120000000"),
        ("TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-01-01 06:00:00'"),
    ):
        sql = sql.replace(scaled, own)
    return sql


for _name in ("pump_actions", "pump_runtime"):
    ORACLE[f"{_name}_default"] = _as_shipped(ORACLE[_name])

# The same results out of streams. A stream's clock is the newest event time.
for _name in (
    "hourly_kpis", "kpi_keyed", "ph_ma10", "alerts", "ingest_json", "ingest_smoothed",
    "latest_state", "pump_actions",
):
    ORACLE[f"{_name}_stream"] = ORACLE[_name]
ORACLE["offline_spans_stream"] = ORACLE["offline_spans"].replace(
    "TIMESTAMP '2024-01-30 12:00:00'", "(SELECT max(ts) FROM readings)"
)
ORACLE["temp_ranking_stream"] = _sql(
    _READING_CTES,
    """SELECT device_id, 'reading:' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS id, arg_max(temperature, seq) AS temperature
FROM (SELECT device_id, ts, seq, temperature FROM readings
      UNION ALL SELECT device_id, ts, seq + 1000000000000, temperature - 20 FROM readings WHERE seq % 3 = 0)
GROUP BY device_id, epoch_us(ts) // 1000 ORDER BY temperature DESC, id DESC, device_id DESC LIMIT 10""",
)
