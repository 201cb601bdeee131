"""Sensor and unit conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolens import constants as C


def adc_to_volts(count: Column) -> Column:
    return count * F.lit(C.ADC_REFERENCE_VOLTS / C.ADC_FULL_SCALE)


def volts_to_tds_ppm(volts: Column) -> Column:
    cubic = F.lit(C.TDS_CUBIC) * volts * volts * volts
    square = F.lit(C.TDS_SQUARE) * volts * volts
    return (cubic + square + F.lit(C.TDS_LINEAR) * volts) * F.lit(C.TDS_FACTOR)


def volts_to_ph(volts: Column) -> Column:
    return F.lit(C.PH_NEUTRAL) + (F.lit(C.PH_NEUTRAL_VOLTS) - volts) / F.lit(C.PH_VOLTS_PER_UNIT)


def ph_to_volts(ph: Column) -> Column:
    """Inverse of :func:`volts_to_ph`."""
    return F.lit(C.PH_NEUTRAL_VOLTS) - (ph - F.lit(C.PH_NEUTRAL)) * F.lit(C.PH_VOLTS_PER_UNIT)


def ingest_ph(volts: Column) -> Column:
    """Fixed calibration line of the network ingest path."""
    return F.lit(C.INGEST_PH_SLOPE) * volts + F.lit(C.INGEST_PH_INTERCEPT)


def serial_ph(reading: Column) -> Column:
    """Fixed calibration line of the serial ingest path."""
    return reading * F.lit(C.SERIAL_PH_SLOPE) + F.lit(C.SERIAL_PH_INTERCEPT)


def ppm_to_conductivity(ppm: Column, digits: int | None = 2) -> Column:
    """ppm to µS/cm; the ingest path rounds before it smooths."""
    value = ppm * F.lit(C.EC_MULTIPLIER) / F.lit(C.EC_DIVISOR)
    return value if digits is None else F.round(value, digits)


def water_level(distance: Column, digits: int | None = 2) -> Column:
    """Litres in the tank from the distance to the surface, clamped to the tank.

    ``greatest`` and ``least`` skip nulls, so an absent distance is kept absent.
    """
    litres = F.lit(C.TANK_EMPTY_LITRES) - distance / F.lit(C.TANK_CM_PER_LITRE)
    clamped = F.greatest(F.lit(C.TANK_MIN_LITRES), F.least(F.lit(C.TANK_MAX_LITRES), litres))
    clamped = clamped if digits is None else F.round(clamped, digits)
    return F.when(distance.isNotNull(), clamped)


def echo_to_cm(micros: Column) -> Column:
    """Half the echo's way in whole centimetres (the fraction is cut off)."""
    return (micros * F.lit(C.SOUND_CM_PER_US) / F.lit(2)).cast("bigint")


def dose_seconds(ml: float = C.DOSE_ML, ml_per_second: float = C.DOSE_ML_PER_SECOND) -> float:
    return ml / ml_per_second
