"""Weather classes, risks and their part in consumption. Column in, Column out; bounds are the metering model's fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltaic.functions.ladders import above, below, first_match


def _bands(value: Column, under: tuple, upto: list[tuple], over: str) -> Column:
    """A label under the first bound, then up to and with each next one, then over the last; null is UNKNOWN."""
    steps = [(value < under[0], under[1]), *((value <= bound, label) for bound, label in upto), (value > upto[-1][0], over)]
    return first_match(steps, "UNKNOWN")


def impacts(celsius: Column, humidity: Column, wind: Column, rain: Column) -> dict[str, Column]:
    """How each measure bears on consumption, a comfort index and a severity, both from 0 to 100."""
    comfort = [(18, 24, 40, 60, 1, 5, 100), (15, 27, 30, 70, 0, 10, 80), (10, 30, 20, 80, 0, 15, 60), (5, 35, 10, 90, 0, 20, 40)]
    outside = lambda lo, hi: (celsius < lo) | (celsius > hi)
    severity = [(outside(-10, 40), 100), (outside(-5, 35), 80), (outside(0, 30), 60), (outside(5, 25), 40), (outside(10, 20), 20)]
    return {
        "temperature_impact": _bands(celsius, (0, "HEATING_DEMAND"), [(15, "MILD_HEATING"), (25, "COMFORTABLE"), (30, "MILD_COOLING")], "COOLING_DEMAND"),
        "humidity_impact": _bands(humidity, (30, "DRY_CONDITIONS"), [(50, "COMFORTABLE"), (70, "MODERATE_HUMIDITY")], "HIGH_HUMIDITY"),
        "wind_impact": _bands(wind, (2, "CALM"), [(5, "LIGHT_BREEZE"), (10, "MODERATE_WIND"), (20, "STRONG_WIND")], "VERY_STRONG_WIND"),
        "precipitation_impact": F.when(rain == 0, "NO_RAIN").otherwise(_bands(rain, (5, "LIGHT_RAIN"), [(15, "MODERATE_RAIN"), (30, "HEAVY_RAIN")], "VERY_HEAVY_RAIN")),
        "comfort_index": first_match([(celsius.between(a, b) & humidity.between(c, d) & wind.between(e, f), points) for a, b, c, d, e, f, points in comfort], 20),
        "severity": first_match(severity, 0),
    }


def demand_multiplier(celsius: Column) -> Column:
    """What consumption is expected to be multiplied by."""
    return first_match([(celsius < 0, 1.5), (celsius <= 15, 1.2), (celsius <= 25, 1.0), (celsius <= 30, 1.1), (celsius > 30, 1.3)], 1.0)


def seasonal_pattern(season: Column, celsius: Column) -> Column:
    return first_match(
        [
            ((season == "WINTER") & (celsius < 10), "WINTER_HEATING"),
            ((season == "SUMMER") & (celsius > 25), "SUMMER_COOLING"),
            ((season == "SPRING") & celsius.between(15, 25), "SPRING_COMFORT"),
            ((season == "FALL") & celsius.between(10, 20), "FALL_COMFORT"),
        ],
        "SEASONAL_TRANSITION",
    )


def air(celsius: Column, humidity: Column, wind: Column, pressure: Column, elevation: Column) -> dict[str, Column]:
    """Derived quantities of a station's air. Chill holds up to 10 degrees and is what is felt in any wind."""
    gust = F.pow(wind, F.lit(0.16))
    chill = F.when(celsius <= 10, 13.12 + 0.6215 * celsius - 11.37 * gust + 0.3965 * celsius * gust).otherwise(celsius)
    heat = F.when((celsius > 26.7) & (humidity > 40), celsius + 0.5 * (humidity - 40)).otherwise(celsius)
    return {
        "temperature_f": F.round(celsius * 9 / 5 + 32, 2),
        "temperature_k": celsius + 273.15,
        "dew_point": celsius - (100 - humidity) / 5,
        "heat_index": heat,
        "wind_chill": chill,
        "apparent_temperature": F.when(wind > 0, chill).otherwise(heat),
        "sea_level_pressure": pressure + elevation / 8.3,
        "air_density": pressure * 100 / (287.05 * (celsius + 273.15)),
    }


def storm_risk(pressure: Column, wind: Column, rain: Column, humidity: Column) -> Column:
    return first_match([(pressure < 1000, 0.8), (wind > 20, 0.9), (rain > 10, 0.7), (humidity > 90, 0.6)], 0.1)


def classes(celsius: Column, humidity: Column, wind: Column, rain: Column, visibility: Column, hour: Column) -> dict[str, Column]:
    return {
        "comfort_level": first_match([(celsius.between(20, 25) & humidity.between(30, 70), "COMFORTABLE"), (celsius < 10, "COLD"), (celsius > 30, "HOT"), (humidity > 80, "HUMID"), (humidity < 20, "DRY")], "MODERATE"),
        "condition": first_match([(rain > 5, "HEAVY_RAIN"), (rain > 0.5, "LIGHT_RAIN"), (wind > 15, "WINDY"), (visibility < 1, "FOGGY"), (celsius < 0, "FREEZING"), (celsius > 35, "EXTREME_HEAT")], "CLEAR"),
        "uv_risk": F.when(hour.between(10, 16), above(celsius, [(30, "HIGH"), (25, "MODERATE")], "LOW")).otherwise("LOW"),
        "temperature_class": below(celsius, [(-10, "EXTREME_COLD"), (0, "COLD"), (15, "COOL"), (25, "MILD"), (35, "WARM")], "HOT"),
    }


#: Regions by the beginning of a station's id, and their climates.
CLIMATES = {"NORTH": "TEMPERATE", "SOUTH": "TROPICAL", "EAST": "CONTINENTAL", "WEST": "MARITIME"}


def place_classes(station: Column, elevation: Column) -> dict[str, Column]:
    region = first_match([(station.startswith(name), name) for name in CLIMATES], "CENTRAL")
    return {
        "station_region": region,
        "climate_zone": first_match([(region == name, zone) for name, zone in CLIMATES.items()], "MIXED"),
        "elevation_class": below(elevation, [(100, "LOWLAND"), (500, "HILLS"), (1000, "MOUNTAINS")], "HIGH_MOUNTAINS"),
    }


def outlook(celsius: Column, day_mean: Column, week_mean: Column, pressure: Column, pressure_mean: Column, humidity: Column, wind: Column, rain: Column, storm: Column) -> dict[str, Column]:
    """Simple forecasts from trailing means of a day and a week, the chance of change, and the risk of extremes."""
    return {
        "forecast_hour": day_mean * 0.7 + celsius * 0.3,
        "forecast_day": week_mean * 1.01,
        "rain_forecast": rain * first_match([(pressure < 1010, 1.5), (humidity > 80, 1.2)], 0.8),
        "change_chance": first_match([(pressure - pressure_mean < -5, 0.8), (pressure - pressure_mean > 5, 0.3), (celsius - day_mean > 5, 0.6), (wind > 15, 0.7)], 0.2),
        "extreme_risk": first_match([(storm > 0.7, "HIGH"), (storm > 0.4, "MODERATE"), (celsius > 40, "HEAT_WAVE"), (celsius < -20, "COLD_WAVE")], "LOW"),
    }


def grid_classes(load: Column, generation: Column, health: Column, hertz: Column, kilovolts: Column, used: Column, volatility: Column) -> dict[str, Column]:
    """Classes of a grid's load and generation in MW, and what its health (0 to 1) and state say of rating and risk."""
    return {
        "load_class": below(load, [(1000, "LOW_LOAD"), (5000, "MEDIUM_LOAD"), (10000, "HIGH_LOAD")], "VERY_HIGH_LOAD"),
        "generation_class": below(generation, [(500, "LOW_GENERATION"), (2000, "MEDIUM_GENERATION"), (5000, "HIGH_GENERATION")], "VERY_HIGH_GENERATION"),
        "rating": first_match([(health >= 0.9, "EXCELLENT"), (health >= 0.7, "GOOD"), (health >= 0.5, "FAIR")], "POOR"),
        "reliability": first_match([(health >= 0.9, 1.0), (health >= 0.7, 0.8), (health >= 0.5, 0.6)], 0.4),
        "maintenance_risk": first_match([((hertz < 49.5) | (hertz > 50.5), 0.9), ((kilovolts < 200) | (kilovolts > 250), 0.8), (used > 0.95, 0.7), (volatility > 0.1, 0.6)], 0.1),
    }


def grid_advice(frequency: Column, voltage: Column, stable: Column, critical: Column, warning: Column, anomalies: Column, used: Column, stressed: Column) -> dict[str, Column]:
    """From scores and percentages of a grid's states: the weighted score, its class, health, remedy, risk and urgency."""
    score = frequency * 0.3 + voltage * 0.3 + stable * 0.4
    reach = lambda *steps, otherwise: first_match([(score >= bound, label) for bound, label in steps], otherwise)
    return {
        "score": score,
        "score_class": reach((90, "EXCELLENT"), (80, "GOOD"), (70, "FAIR"), (60, "POOR"), otherwise="CRITICAL"),
        "health": first_match([((score >= 90) & ~stressed, "HEALTHY"), ((score >= 80) & ~stressed, "GOOD"), ((score >= 70) | stressed, "WARNING"), (score >= 60, "CRITICAL")], "EMERGENCY"),
        "remedy": first_match([(frequency < 80, "FREQUENCY_STABILIZATION"), (voltage < 80, "VOLTAGE_REGULATION"), (used > 90, "CAPACITY_EXPANSION"), (anomalies > 15, "DATA_QUALITY_IMPROVEMENT"), (stable < 85, "GRID_STABILIZATION"), (critical > 5, "EMERGENCY_RESPONSE")], "MAINTENANCE_SCHEDULING"),
        "risk": first_match([((critical > 10) | (score < 60), "HIGH_RISK"), ((critical > 5) | (score < 70), "MEDIUM_RISK"), ((warning > 15) | (score < 80), "LOW_RISK")], "MINIMAL_RISK"),
        "urgency": first_match([((critical > 10) | (stable < 70), "URGENT"), ((critical > 5) | (stable < 80), "HIGH"), ((warning > 15) | (stable < 90), "MEDIUM"), ((warning > 10) | (anomalies > 15), "LOW")], "NONE"),
        "capacity": above(used, [(95, "CRITICAL_CAPACITY"), (85, "HIGH_CAPACITY"), (70, "NORMAL_CAPACITY"), (50, "LOW_CAPACITY")], "UNDERUTILIZED"),
    }


def in_country(latitude: Column, longitude: Column) -> Column:
    """Within the bounding box of Germany."""
    return latitude.between(47.27, 55.06) & longitude.between(5.87, 15.04)


def grid_zone(longitude: Column) -> Column:
    return below(longitude, [(8.0, "TenneT"), (10.0, "50Hertz"), (12.0, "Amprion")], "TransnetBW")
