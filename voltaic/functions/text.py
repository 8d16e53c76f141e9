"""Cleaning, parsing, hashing and masking of text, and time and place features. Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltaic.functions.ladders import first_match


def blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def clean_string(column: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default))


def clean_number(column: Column, default: float = 0.0) -> Column:
    """Text or number as a double; null, blank and unreadable text is the default."""
    return F.coalesce(F.try_to_number(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit("S999999999999D999999")).cast("double"), column.try_cast("double"), F.lit(default))


def upper_clean(column: Column) -> Column:
    return F.when(blank(column), "UNKNOWN").otherwise(F.upper(F.trim(column)))


#: Spellings of tariffs, tiers and truth values.
TARIFFS = {"TIME_OF_USE": ["TOU", "TIME_OF_USE", "TIME OF USE"], "FLAT_RATE": ["FLAT", "FLAT_RATE", "FLAT RATE"], "TIERED": ["TIERED", "TIER", "TIERED_RATE"]}
TIERS = {t: [t, f"{t}_QUALITY"] for t in ("EXCELLENT", "GOOD", "FAIR", "POOR")}
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def synonyms(column: Column, names: dict[str, list[str]]) -> Column:
    """The name one of whose spellings the value is; other values in upper case."""
    value = upper_clean(column)
    out = None
    for name, spellings in names.items():
        out = (out.when if out is not None else F.when)(value.isin(*spellings), F.lit(name))
    return out.otherwise(value)


def boolean(column: Column) -> Column:
    value = F.lower(F.trim(column))
    return F.when(value.isin(*TRUE), True).when(value.isin(*FALSE), False)


def id_part(column: Column, position: int, separator: str = "-", default: str | None = None) -> Column:
    return F.when(blank(column), F.lit(default)).otherwise(F.split_part(column, F.lit(separator), F.lit(position)))


def json_field(column: Column, key: str) -> Column:
    return F.when(column != "", F.get_json_object(column, f"$.{key}"))


def list_field(column: Column, separator: str = ",") -> Column:
    return F.when(~blank(column), F.split(F.trim(column), re.escape(separator)))


def row_hash(columns: list[Column]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def surrogate_key(columns: list[Column], sentinel: str = "_null_") -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(sentinel)) for c in columns]))


METER_ID = r"^MET-[A-Z]{3}-[A-Z]-[0-9]{6}$"


def is_meter_id(column: Column) -> Column:
    return column.rlike(METER_ID)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "WINTER").when(month.isin(3, 4, 5), "SPRING").when(month.isin(6, 7, 8), "SUMMER").when(month.isin(9, 10, 11), "FALL")


def time_features(ts: Column) -> dict[str, Column]:
    """Calendar and business features; day_of_week is 0 for Sunday, week_of_year is ISO's."""
    weekday, hour = F.dayofweek(ts) - 1, F.hour(ts)
    return {
        "hour_of_day": hour, "day_of_week": weekday, "month_of_year": F.month(ts), "quarter_of_year": F.quarter(ts), "year": F.year(ts),
        "week_of_year": F.weekofyear(ts), "day_of_year": F.dayofyear(ts), "day_name": F.date_format(ts, "EEEE"), "month_name": F.date_format(ts, "MMMM"),
        "is_peak_hour": hour.between(17, 21), "is_off_peak_hour": hour.between(22, 23) | hour.between(0, 6), "is_weekend": weekday.isin(0, 6),
        "day_type": F.when(weekday.isin(0, 6), "WEEKEND").otherwise("WEEKDAY"), "season": season(F.month(ts)), "is_peak_season": F.month(ts).isin(6, 7, 8, 12, 1),
    }


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value that comes round after period."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def quadrant(latitude: Column, longitude: Column) -> Column:
    """Around 50 degrees north and the prime meridian."""
    place = first_match([((latitude > 50) & (longitude > 0), "NORTH_EAST"), ((latitude > 50) & (longitude <= 0), "NORTH_WEST"), (longitude > 0, "SOUTH_EAST")], "SOUTH_WEST")
    return F.when(latitude.isNull() | longitude.isNull(), "UNKNOWN").otherwise(place)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, F.lit(2)) + F.pow(lon1 - lon2, F.lit(2)))


def letter_grade(score: Column) -> Column:
    return first_match([(score >= 0.9, "A"), (score >= 0.8, "B"), (score >= 0.7, "C"), (score >= 0.6, "D")], "F")


def audit(run_id: str, at: str) -> dict[str, Column]:
    """When a row was written and by which run; at is an argument, as nothing here reads the clock."""
    now = F.lit(at).cast("timestamp_ntz")
    return {"created_at": now, "updated_at": now, "run_id": F.lit(run_id)}


def origin(system: str, batch_id: str, at: str) -> dict[str, Column]:
    return {"source_system": F.lit(system), "ingestion_batch_id": F.lit(batch_id), "processed_at": F.lit(at).cast("timestamp_ntz")}
