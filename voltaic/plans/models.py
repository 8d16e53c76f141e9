"""The metering models: staging, hourly fact, daily metrics, efficiency and dimensions. DataFrame in, DataFrame out.

Nothing here runs an action or reads the clock; thresholds are arguments or stand in voltaic.functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.functions import energy, ladders, text


def stage_readings(df: DataFrame) -> DataFrame:
    """Readings with the required fields, their validity flags, tier, time features, category and quality flag."""
    c = F.col
    valid = {
        "is_valid_consumption": ladders.in_range(c("consumption_kwh"), 0, 1000),
        "is_valid_voltage": ladders.in_range(c("voltage_v"), 200, 250),
        "is_valid_current": F.coalesce(c("current_a") >= 0, F.lit(True)),
        "is_valid_power_factor": ladders.in_range(c("power_factor"), 0, 1),
        "is_valid_frequency": ladders.in_range(c("frequency_hz"), 45, 65),
    }
    names = list(valid)
    every = lambda n: ladders.reduce(ladders.and_, [c(x) for x in names[:n]])
    staged = df.filter(c("reading_timestamp").isNotNull() & c("meter_id").isNotNull() & c("consumption_kwh").isNotNull()).withColumns(valid)
    return staged.withColumns(
        {
            "calculated_quality_tier": ladders.first_match([(every(5), "EXCELLENT"), (every(3), "GOOD"), (every(1), "FAIR")], "POOR"),
            "consumption_category": ladders.consumption_category(c("consumption_kwh")),
            "quality_flag": ladders.quality_flag({n.removeprefix("is_valid_"): c(n) for n in names}),
            "quality_issues": ladders.issue_count({n: c(n) for n in names}),
            **text.time_features(c("reading_timestamp")),
        }
    )


def hourly_fact(staged: DataFrame) -> DataFrame:
    """One row a meter and hour: sums, means, extremes, tier counts, percentages and classes."""
    c = F.col
    tiers = ("EXCELLENT", "GOOD", "FAIR", "POOR")
    hourly = staged.groupBy("meter_id", F.date_trunc("hour", "reading_timestamp").cast("timestamp_ntz").alias("date_hour")).agg(
        F.count("*").alias("reading_count"),
        *[f("consumption_kwh").alias(f"{n}_consumption_kwh") for n, f in (("total", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max), ("stddev", F.stddev))],
        *[F.avg(x).alias(f"avg_{x}") for x in ("voltage_v", "current_a", "power_factor", "frequency_hz", "quality_score", "anomaly_score")],
        *[F.count_if(c("calculated_quality_tier") == t).alias(f"{t.lower()}_quality_count") for t in tiers],
        F.count_if("is_anomaly").alias("anomaly_count"),
        *[F.bool_or(x).alias(x) for x in ("is_peak_hour", "is_off_peak_hour", "is_weekend")],
        F.max("tariff_type").alias("tariff_type"),
    )
    hourly = hourly.withColumns({f"{t.lower()}_quality_percent": ladders.percent(c(f"{t.lower()}_quality_count"), c("reading_count"), 0.0) for t in tiers})
    hourly = hourly.withColumn("anomaly_percent", ladders.percent(c("anomaly_count"), c("reading_count"), 0.0))
    peak, off, end = c("is_peak_hour"), c("is_off_peak_hour"), c("is_weekend")
    return hourly.withColumns(
        {
            "consumption_category": ladders.consumption_category(c("total_consumption_kwh")),
            "overall_quality_tier": ladders.quality_distribution_tier(*(c(f"{t}_quality_percent") for t in ("excellent", "good", "fair"))),
            "anomaly_classification": ladders.anomaly_classification(c("anomaly_percent")),
            "time_period": ladders.first_match([(peak & ~end, "PEAK_WEEKDAY"), (peak & end, "PEAK_WEEKEND"), (off & ~end, "OFF_PEAK_WEEKDAY"), (off & end, "OFF_PEAK_WEEKEND")], "OTHER"),
        }
    )


def daily_metrics(hourly: DataFrame) -> DataFrame:
    """One row a meter and day, from the hourly fact: averages are of the hours' averages, as the model defines them."""
    c = F.col
    tiers = ("excellent", "good", "fair", "poor")
    daily = hourly.groupBy("meter_id", F.to_date("date_hour").alias("date")).agg(
        F.sum("total_consumption_kwh").alias("daily_consumption_kwh"),
        F.avg("avg_consumption_kwh").alias("avg_hourly_consumption_kwh"),
        F.min("min_consumption_kwh").alias("min_hourly_consumption_kwh"),
        F.max("max_consumption_kwh").alias("max_hourly_consumption_kwh"),
        F.stddev("avg_consumption_kwh").alias("stddev_hourly_consumption_kwh"),
        F.sum("reading_count").alias("total_readings"),
        F.avg("reading_count").alias("avg_readings_per_hour"),
        *[F.sum(f"{t}_quality_count").alias(f"total_{t}_readings") for t in tiers],
        F.sum("anomaly_count").alias("total_anomalies"),
        F.avg("avg_power_factor").alias("avg_power_factor"),
        F.bool_or("is_peak_hour").alias("had_peak_hours"),
        F.bool_or("is_off_peak_hour").alias("had_off_peak_hours"),
    )
    daily = daily.withColumns({f"{t}_quality_percent": ladders.percent(c(f"total_{t}_readings"), c("total_readings"), 0.0) for t in tiers})
    daily = daily.withColumn("anomaly_percent", ladders.percent(c("total_anomalies"), c("total_readings"), 0.0))
    peak, off = c("had_peak_hours"), c("had_off_peak_hours")
    return daily.withColumns(
        {
            "consumption_category": ladders.consumption_category(c("daily_consumption_kwh"), ladders.DAILY_CONSUMPTION),
            "overall_quality_tier": ladders.quality_distribution_tier(*(c(f"{t}_quality_percent") for t in ("excellent", "good", "fair"))),
            "anomaly_classification": ladders.anomaly_classification(c("anomaly_percent")),
            "efficiency_adjusted_kwh": energy.efficiency_adjusted(c("daily_consumption_kwh"), c("avg_power_factor")),
            "consumption_pattern": ladders.first_match([(peak & off, "MIXED"), (peak, "PEAK_ONLY"), (off, "OFF_PEAK_ONLY")], "UNKNOWN"),
            "data_completeness": ladders.at_least(c("total_readings"), [(24, "COMPLETE"), (12, "PARTIAL")], "INCOMPLETE"),
        }
    )


def energy_efficiency(hourly: DataFrame) -> DataFrame:
    """Load factor, tiers, the additive score from 0 to 100, waste and the first remedy that fits."""
    c = F.col
    pf, volts, hertz, anomalies = c("avg_power_factor"), c("avg_voltage_v"), c("avg_frequency_hz"), c("anomaly_percent")
    tiers = energy.efficiency_tiers(pf, volts, hertz, c("avg_quality_score"))
    out = hourly.withColumns({"load_factor": ladders.ratio(c("avg_consumption_kwh"), c("max_consumption_kwh")), **tiers})
    score = energy.tier_points(c("power_factor_tier")) + energy.tier_points(c("voltage_tier"), 5) + energy.tier_points(c("frequency_tier"), 5) + energy.tier_points(c("quality_tier"))
    waste = (pf < 0.85) | (volts < 210) | (volts > 250) | (hertz < 49.5) | (hertz > 50.5) | (anomalies > 10)
    return out.withColumn("overall_efficiency_score", score).withColumns(
        {
            "efficiency_class": ladders.at_least(c("overall_efficiency_score"), [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR")], "POOR"),
            "has_energy_waste": F.coalesce(waste, F.lit(False)),
            "opportunity": ladders.first_match(
                [
                    ((pf < 0.90) & (pf >= 0.85), "POWER_FACTOR_CORRECTION"),
                    ((volts < 220) | (volts > 240), "VOLTAGE_REGULATION"),
                    ((hertz < 49.8) | (hertz > 50.2), "FREQUENCY_STABILIZATION"),
                    (anomalies > 5, "DATA_QUALITY_IMPROVEMENT"),
                    (c("load_factor") < 0.5, "LOAD_BALANCING"),
                ],
                "NO_OPTIMIZATION_NEEDED",
            ),
        }
    )


def dim_meters(staged: DataFrame, as_of: str) -> DataFrame:
    """One row a meter: first and last reading, counts by tier, ratios, activity on the day as_of."""
    c = F.col
    tiers = ("EXCELLENT", "GOOD", "FAIR", "POOR")
    dim = staged.groupBy("meter_id", "latitude", "longitude").agg(
        F.min("reading_timestamp").alias("first_reading"), F.max("reading_timestamp").alias("last_reading"), F.count("*").alias("total_readings"),
        F.avg("consumption_kwh").alias("avg_consumption_kwh"), F.sum("consumption_kwh").alias("total_consumption_kwh"), F.avg("quality_score").alias("avg_quality_score"),
        *[F.count_if(c("calculated_quality_tier") == t).alias(f"{t.lower()}_readings") for t in tiers], F.count_if("is_anomaly").alias("anomaly_count"),
    )
    days = F.datediff("last_reading", "first_reading")
    return dim.withColumns(
        {
            "days_in_service": days,
            "readings_per_day": ladders.ratio(c("total_readings"), days, 0.0),
            "excellent_percent": ladders.percent(c("excellent_readings"), c("total_readings"), 0.0),
            "anomaly_percent": ladders.percent(c("anomaly_count"), c("total_readings"), 0.0),
            "region": text.id_part(c("meter_id"), 2, default="UNKNOWN"),
            "quadrant": text.quadrant(c("latitude"), c("longitude")),
            "status": F.when(F.datediff(F.lit(as_of).cast("date"), "last_reading") > 7, "INACTIVE").otherwise("ACTIVE"),
        }
    ).withColumn("anomaly_classification", ladders.anomaly_classification(c("anomaly_percent")))


def grid_performance(df: DataFrame) -> DataFrame:
    """Scores of frequency, voltage and use of a grid state, their weighted sum, class, health and advice.

    Needs frequency_hz, voltage_v, load_mw, capacity_mw.
    """
    c = F.col
    hertz, volts = c("frequency_hz"), c("voltage_v")
    used = energy.utilization(c("load_mw"), c("capacity_mw"))
    off_hz, off_v = F.abs(hertz - 50), F.abs(volts - 230)
    return df.withColumns(
        {
            "utilization_percent": used,
            "frequency_score": ladders.within(hertz, [(49.8, 50.2, 100), (49.5, 50.5, 80), (49.0, 51.0, 60), (48.0, 52.0, 40)], 20),
            "voltage_score": ladders.within(volts, [(220, 240, 100), (210, 250, 80), (200, 260, 60)], 20),
            "stability_index": 1 - off_hz / 0.5 - off_v / 20,
            "stability_score": energy.grid_stability(hertz, volts, c("load_mw"), c("capacity_mw")),
            "load_category": ladders.below(c("load_mw") / c("capacity_mw"), [(0.3, "LOW"), (0.7, "NORMAL"), (0.9, "HIGH")], "CRITICAL"),
            "alert_level": ladders.first_match([((off_hz > 0.5) | (off_v > 23), "CRITICAL"), ((off_hz > 0.2) | (off_v > 11.5), "WARNING"), (used > 90, "HIGH_LOAD")], "NORMAL"),
        }
    ).withColumns(
        {
            "performance_score": 0.3 * c("frequency_score") + 0.3 * c("voltage_score") + 0.4 * c("stability_score") * 100,
            "health": 0.4 * c("stability_score") + F.when(volts.between(220, 240), 0.3).otherwise(0.0) + F.when(c("utilization_percent") < 80, 0.3).otherwise(0.0),
        }
    ).withColumn("performance_class", ladders.at_least(c("performance_score"), [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR")], "POOR"))


def weather_staging(df: DataFrame) -> DataFrame:
    """Validity, categories, condition and derived quantities of weather rows (temperature_c, humidity, wind, precipitation)."""
    c = F.col
    t, h, w, p = c("temperature_c"), c("humidity"), c("wind"), c("precipitation")
    checks = {"temperature": ladders.in_range(t, -50, 60), "humidity": ladders.in_range(h, 0, 100), "wind": F.coalesce(w >= 0, F.lit(True)), "precipitation": F.coalesce(p >= 0, F.lit(True))}
    return df.withColumns(
        {
            "quality_flag": ladders.quality_flag(checks),
            "temperature_category": ladders.temperature_category(t),
            "humidity_category": ladders.humidity_category(h),
            "weather_condition": ladders.first_match([((p > 5) & (w > 15), "STORMY"), (p > 5, "HEAVY_RAIN"), (p > 0, "RAINY"), (h > 80, "CLOUDY")], "CLEAR"),
            "weather_impact": energy.weather_impact(t, h, w, p),
            "temperature_f": t * 9 / 5 + 32,
            "dew_point": t - (100 - h) / 5,
            "demand_factor": energy.demand_factor(t, h, w, F.lit(0.0)),
            **energy.degree_days(t),
        }
    )


def meter_etl(df: DataFrame) -> DataFrame:
    """Normalised ids, electrical derivations, tariff and voltage classes, id parts, risk and completeness."""
    c = F.col
    load = c("consumption_kwh")
    parts = [c(x) for x in ("consumption_kwh", "voltage_v", "current_a", "power_factor", "frequency_hz")]
    return df.withColumn("meter_id", F.upper(F.trim("meter_id"))).withColumns(
        {
            **energy.electrical(c("voltage_v"), c("current_a"), c("power_factor")),
            "tariff_tier": ladders.below(load, [(5.0, "LOW"), (20.0, "MEDIUM"), (35.0, "HIGH")], "VERY_HIGH"),
            "efficiency_class": ladders.at_least(c("power_factor"), [(0.95, "EXCELLENT"), (0.85, "GOOD"), (0.75, "FAIR")], "POOR"),
            "voltage_class": ladders.first_match([(c("voltage_v") < 200, "LOW"), (c("voltage_v") > 250, "HIGH")], "NORMAL"),
            "region_code": F.substring("meter_id", 5, 3),
            "meter_kind": F.when(c("meter_id").rlike("^MET-[A-Z]{3}-R"), "RESIDENTIAL").when(c("meter_id").rlike("^MET-[A-Z]{3}-C"), "COMMERCIAL").otherwise("INDUSTRIAL"),
            "risk": ladders.first_match([(c("is_anomaly") & (load > 40), 0.9), (c("is_anomaly"), 0.8), (c("voltage_v") > 250, 0.7), (c("power_factor") < 0.8, 0.6)], 0.1),
            "completeness": ladders.present_count(parts) / F.lit(5.0),
        }
    )
