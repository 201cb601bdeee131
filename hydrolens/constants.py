"""Physical constants, thresholds, key names and message formats.

Everything here has to equal what the deployed devices and services use, since
stored readings, alert texts and keys were produced with these values. The
operators take them as defaults; none is repeated elsewhere.
"""

# --- fixed values: analogue front end -------------------------------------
ADC_REFERENCE_VOLTS = 3.3
ADC_FULL_SCALE = 4095.0
TDS_CUBIC = 133.42
TDS_SQUARE = -255.86
TDS_LINEAR = 857.39
TDS_FACTOR = 0.5
SOUND_CM_PER_US = 0.034

# --- fixed values: pH probe -----------------------------------------------
PH_NEUTRAL = 7.0
PH_NEUTRAL_VOLTS = 2.5
PH_VOLTS_PER_UNIT = 0.18
INGEST_PH_SLOPE = -39.01
INGEST_PH_INTERCEPT = 68.48
SERIAL_PH_SLOPE = 3.0556
SERIAL_PH_INTERCEPT = -5.139
ONE_POINT_PH_SLOPE = -5.5555

# --- fixed values: conductivity and tank ----------------------------------
EC_MULTIPLIER = 1000
EC_DIVISOR = 500.0
TANK_EMPTY_LITRES = 11.0
TANK_CM_PER_LITRE = 2.0
TANK_MIN_LITRES = 0.0
TANK_MAX_LITRES = 10.0

# --- fixed values: plausible ranges (pH ends belong, temperature ends do not)
PH_MIN, PH_MAX = 0, 14
TEMPERATURE_ABOVE, TEMPERATURE_BELOW = -10, 60

# --- fixed values: alert band and advisory bands --------------------------
ALERT_PH_LOW, ALERT_PH_HIGH = 5.8, 6.8
ALERT_TYPE = "CRITICAL"
ALERT_TEXT = "pH fora da faixa ideal: "
IDEAL_BANDS = {
    "ph": (5.5, 6.5),
    "temperature": (18.0, 28.0),
    "conductivity": (800.0, 1500.0),
    "water_level": (None, 10.0),
}

# --- fixed values: smoothing, staleness, limits ---------------------------
SMOOTHING_ROWS = 10
OFFLINE_AFTER_SECONDS = 30
LOG_READ_LIMIT = 1000
HISTORY_LIMIT = 50
RANKING_LIMIT = 10
REPORT_ROWS = 10

# --- fixed values: pump control -------------------------------------------
DOSE_BELOW_EC = 310.0
DOSE_COOLDOWN_SECONDS = 60
DOSE_ML = 10
DOSE_ML_PER_SECOND = 2.0
CYCLE_PERIOD_SECONDS = 120
CYCLE_RUN_SECONDS = 60
FLAGS = ("circ", "nutri", "auto", "circ_auto")

# --- fixed values: key formats --------------------------------------------
KPI_KEY_PREFIX = "kpi:"
KPI_KEY_FORMAT = "yyyyMMddHH"
RANKING_MEMBER_PREFIX = "reading:"

# --- fixed values: payload keys, first name wins when present --------------
HTTP_KEYS = {
    "ppm": ("eletrocondutividade", "conductivity"),
    "distance": ("distancia", "distance"),
    "temperature": ("temperatura", "temperature"),
    "humidity": ("umidade", "humidity"),
    "raw_ph": ("ph",),
}
SERIAL_KEYS = {
    "ph": ("ph", "pH"),
    "temperature": ("temperatura", "temperature"),
    "humidity": ("umidade", "humidity"),
    "salinity": ("salinidade", "salinity", "eletrocondutividade"),
    "conductivity": ("eletrocondutividade", "conductivity"),
    "distance": ("distancia",),
}
DEVICE_KEYS = {
    "temperature": "temperatura",
    "humidity": "umidade",
    "distance": "distancia",
    "ph": "ph",
    "tds_ppm": "eletrocondutividade",
}
