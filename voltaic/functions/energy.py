"""Business calculations of the metering model. Column in, Column out; the numbers are its fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltaic.functions.ladders import first_match, percent, within

WEEKDAYS, WEEKEND = (1, 2, 3, 4, 5), (0, 6)  # 0 is Sunday


def utilization(load: Column, capacity: Column) -> Column:
    return percent(load, capacity)


def efficiency_adjusted(kwh: Column, power_factor: Column) -> Column:
    return F.when(power_factor > 0, kwh / power_factor).otherwise(kwh)


def consumption_efficiency(kwh: Column, volts: Column, amperes: Column) -> Column:
    return F.when((volts > 0) & (amperes > 0), kwh / (volts * amperes / 1000)).otherwise(kwh)


def power_factor_correction(power_factor: Column, target: float = 0.95) -> Column:
    return F.when(power_factor < target, target - power_factor).otherwise(0.0)


def deviation_percent(actual: Column, nominal: float) -> Column:
    return F.abs(actual - nominal) / nominal * 100


def weather_impact(temperature: Column, humidity: Column, wind: Column, precipitation: Column) -> Column:
    score = first_match(
        [
            ((temperature < 0) | (temperature > 35), 0.8),
            ((humidity > 80) & (wind > 10), 0.6),
            (precipitation > 5, 0.4),
            (temperature.between(15, 25) & humidity.between(40, 60), 1.0),
        ],
        0.7,
    )
    return F.when(temperature.isNotNull() & humidity.isNotNull(), score)


def weather_correlation(temperature: Column, kwh: Column) -> Column:
    score = first_match([((temperature < 10) | (temperature > 30), 0.8), (temperature.between(15, 25), 0.3)], 0.5)
    return F.when(temperature.isNotNull() & kwh.isNotNull(), score)


def demand_period(hour: Column, weekday: Column, intended: bool = False) -> Column:
    """The tariff period. As published, hours 0 to 6 are OFF_PEAK_WEEKDAY on every day; intended: weekends have their own."""
    late, early = hour.between(22, 23), hour.between(0, 6)
    week, end = weekday.isin(*WEEKDAYS), weekday.isin(*WEEKEND)
    off_week = week & (late | early) if intended else (week & late) | early
    off_end = end & (late | early) if intended else (end & late) | early
    return first_match([(week & hour.between(17, 21), "PEAK_WEEKDAY"), (end & hour.between(17, 21), "PEAK_WEEKEND"), (off_week, "OFF_PEAK_WEEKDAY"), (off_end, "OFF_PEAK_WEEKEND")], "OTHER")


def tariff_rate(period: Column, tariff: Column) -> Column:
    by_time = first_match([(period == "PEAK_WEEKDAY", 0.25), (period == "PEAK_WEEKEND", 0.20), (period == "OFF_PEAK_WEEKDAY", 0.10), (period == "OFF_PEAK_WEEKEND", 0.08)], 0.15)
    tiered = F.when(period.isin("PEAK_WEEKDAY", "PEAK_WEEKEND"), 0.20).otherwise(0.12)
    return F.when(tariff == "TIME_OF_USE", by_time).when(tariff == "FLAT_RATE", 0.15).when(tariff == "TIERED", tiered).otherwise(0.15)


def energy_cost(kwh: Column, rate: Column) -> Column:
    return kwh * rate


def carbon_footprint(kwh: Column, intensity: float = 0.5) -> Column:
    return kwh * intensity


def savings_potential(kwh: Column, efficiency: Column) -> Column:
    return F.when(efficiency < 0.8, kwh * (0.8 - efficiency)).otherwise(0.0)


def demand_response(kwh: Column, period: Column) -> Column:
    return F.when(period.isin("PEAK_WEEKDAY", "PEAK_WEEKEND"), kwh * 0.3).otherwise(kwh * 0.1)


def grid_stability(hertz: Column, kilovolts: Column, load: Column, capacity: Column) -> Column:
    score = first_match(
        [
            (hertz.between(49.5, 50.5) & kilovolts.between(220, 240) & (load < capacity * 0.8), 1.0),
            (hertz.between(49.0, 51.0) & kilovolts.between(210, 250) & (load < capacity * 0.9), 0.8),
            (hertz.between(48.0, 52.0) & kilovolts.between(200, 260) & (load < capacity), 0.6),
        ],
        0.3,
    )
    return F.when(hertz.isNotNull() & kilovolts.isNotNull() & load.isNotNull() & capacity.isNotNull(), score)


def maintenance_priority(quality: Column, anomaly_percent: Column, days: Column) -> Column:
    return first_match(
        [
            ((quality < 50) | (anomaly_percent > 30), "URGENT"),
            ((quality < 70) | (anomaly_percent > 20) | (days > 365), "HIGH"),
            ((quality < 80) | (anomaly_percent > 10) | (days > 180), "MEDIUM"),
        ],
        "LOW",
    )


def electrical(volts: Column, amperes: Column, power_factor: Column) -> dict[str, Column]:
    """Apparent, active and reactive power in VA, W and var."""
    apparent = volts * amperes
    active = apparent * power_factor
    return {"apparent_power": apparent, "active_power": active, "reactive_power": F.sqrt(F.greatest(F.lit(0.0), F.pow(apparent, F.lit(2.0)) - F.pow(active, F.lit(2.0))))}


POINTS = {"EXCELLENT": 25, "OPTIMAL": 25, "STABLE": 25, "GOOD": 20, "ACCEPTABLE": 20, "FAIR": 15, "MARGINAL": 15, "UNSTABLE": 15}


def efficiency_tiers(power_factor: Column, volts: Column, hertz: Column, quality: Column) -> dict[str, Column]:
    five = lambda c, steps: first_match([(c >= b, label) for b, label in steps], "VERY_POOR")
    return {
        "power_factor_tier": five(power_factor, [(0.95, "EXCELLENT"), (0.90, "GOOD"), (0.85, "FAIR"), (0.80, "POOR")]),
        "voltage_tier": within(volts, [(220, 240, "OPTIMAL"), (210, 250, "ACCEPTABLE"), (200, 260, "MARGINAL")], "POOR"),
        "frequency_tier": within(hertz, [(49.8, 50.2, "STABLE"), (49.5, 50.5, "ACCEPTABLE"), (49.0, 51.0, "UNSTABLE")], "CRITICAL"),
        "quality_tier": five(quality, [(0.95, "EXCELLENT"), (0.90, "GOOD"), (0.80, "FAIR"), (0.70, "POOR")]),
    }


def tier_points(tier: Column, poor: int = 10) -> Column:
    """25, 20 or 15 for the better tiers; poor for POOR, else 5."""
    return first_match([*((tier == name, points) for name, points in POINTS.items()), (tier == "POOR", poor)], 5)


def meteorology(celsius: Column, humidity: Column, wind_kmh: Column, pressure: Column, elevation: Column) -> dict[str, Column]:
    """Derived weather quantities; the chill holds to 10 degrees."""
    fahrenheit = celsius * 9 / 5 + 32
    dew = celsius - (100 - humidity) / 5
    chill = 13.12 + 0.6215 * celsius - 11.37 * F.pow(wind_kmh, F.lit(0.16)) + 0.3965 * celsius * F.pow(wind_kmh, F.lit(0.16))
    return {
        "temperature_f": fahrenheit,
        "temperature_k": celsius + 273.15,
        "dew_point": dew,
        "wind_chill": F.when(celsius <= 10, chill).otherwise(celsius),
        "sea_level_pressure": pressure * F.pow(1 - 0.0065 * elevation / (celsius + 0.0065 * elevation + 273.15), F.lit(-5.257)),
        "air_density": pressure * 100 / (287.05 * (celsius + 273.15)),
    }


def degree_days(celsius: Column, heating: float = 18.0, cooling: float = 25.0) -> dict[str, Column]:
    return {"heating_degrees": F.greatest(F.lit(0.0), heating - celsius), "cooling_degrees": F.greatest(F.lit(0.0), celsius - cooling)}


def demand_factor(celsius: Column, humidity: Column, wind: Column, cloud: Column) -> Column:
    """1 and what heating under 15 and cooling over 25 degrees, humidity, wind and cloud add, from 0.5 to 2."""
    heat = F.when(celsius < 15, (15 - celsius) * 0.02).when(celsius > 25, (celsius - 25) * 0.03).otherwise(0.0)
    extra = F.when(humidity > 70, 0.1).otherwise(0.0) + F.when(wind > 10, 0.05).otherwise(0.0) + F.when(cloud > 80, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1 + heat + extra))
