"""Conditions on meters: what their ratings allow, calibration, maintenance, nearness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: kilometres of a degree of latitude.
DEGREE_KM = 111.0


def rating_checks(volts: Column, amperes: Column, power_factor: Column, rated_volts: Column, rated_amperes: Column) -> dict[str, Column]:
    """Whether measured values lie in what the ratings allow: volts within a tenth, amperes from a thousandth to 1.2 times
    the rating, power factors from 0.5 to 1. A null value or rating gives null."""
    return {
        "volts_ok": volts.between(rated_volts * 0.9, rated_volts * 1.1),
        "amperes_ok": amperes.between(rated_amperes * 0.001, rated_amperes * 1.2),
        "power_factor_ok": power_factor.between(0.5, 1.0),
    }


def accuracy_tolerance(accuracy_class: Column) -> Column:
    """The tolerance in percent of classes 1 to 3; null for others."""
    return F.when(accuracy_class.isin("1", "2", "3"), accuracy_class.cast("double"))


def calibration(due: Column, as_of: str) -> dict[str, Column]:
    """Whether calibration is due on a day, and the days left until then; without a date it is not due."""
    today = F.to_date(F.lit(as_of))
    return {"calibration_due": F.coalesce(due <= today, F.lit(False)), "days_left": F.date_diff(due, today)}


def needs_maintenance(tier: Column, last_reading: Column, status: Column, as_of: str, days: int = 7) -> Column:
    """Poor quality, no reading for some days, or already in maintenance; a null says nothing."""
    stale = last_reading < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return F.coalesce(tier == "POOR", F.lit(False)) | F.coalesce(stale, F.lit(False)) | F.coalesce(status == "MAINTENANCE", F.lit(False))


def near(latitude: Column, longitude: Column, at: tuple[float, float], radius_km: float, as_published: bool = False) -> Column:
    """Whether a place lies in the box of radius_km around another. A degree of longitude shrinks with the cosine of the
    latitude; as_published divides by the latitude itself instead."""
    lat, lon = F.lit(float(at[0])), F.lit(float(at[1]))
    width = F.abs(lat) if as_published else F.cos(F.radians(lat))
    by_lat, by_lon = F.lit(radius_km / DEGREE_KM), F.try_divide(F.lit(float(radius_km)), F.lit(DEGREE_KM) * width)
    return latitude.between(lat - by_lat, lat + by_lat) & longitude.between(lon - by_lon, lon + by_lon)
