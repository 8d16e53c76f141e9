"""Building blocks of classifications: threshold ladders, guarded ratios, range checks. Column in, Column out."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Bound = tuple[float, object]


def _steps(column: Column, steps: list[Bound], test, otherwise) -> Column:
    out = None
    for bound, label in steps:
        out = (out.when if out is not None else F.when)(test(column, bound), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def at_least(column: Column, steps: list[Bound], otherwise) -> Column:
    """The label of the first bound that the value reaches; a null reaches none."""
    return _steps(column, steps, lambda c, b: c >= b, otherwise)


def below(column: Column, steps: list[Bound], otherwise) -> Column:
    """The label of the first bound that the value is under; a null is under none."""
    return _steps(column, steps, lambda c, b: c < b, otherwise)


def above(column: Column, steps: list[Bound], otherwise) -> Column:
    return _steps(column, steps, lambda c, b: c > b, otherwise)


def within(column: Column, steps: list[tuple[float, float, object]], otherwise) -> Column:
    """The label of the first range, both ends included, that holds the value."""
    return _steps(column, [((lo, hi), label) for lo, hi, label in steps], lambda c, b: c.between(*b), otherwise)


def first_match(steps: list[tuple[Column, object]], otherwise) -> Column:
    out = None
    for test, label in steps:
        out = (out.when if out is not None else F.when)(test, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def ratio(part: Column, whole: Column, default=None) -> Column:
    """part / whole where whole is positive, else default."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(default).cast("double"))


def percent(part: Column, whole: Column, default=None) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * 100).otherwise(F.lit(default).cast("double"))


def in_range(column: Column, low: float, high: float) -> Column:
    """False outside the range; null counts as inside."""
    return F.coalesce((column >= low) & (column <= high), F.lit(True))


def completeness(columns: list[Column]) -> Column:
    """COMPLETE if no column is null, PARTIAL if some are not, else INCOMPLETE."""
    present = [c.isNotNull() for c in columns]
    return first_match([(reduce(and_, present), "COMPLETE"), (reduce(or_, present), "PARTIAL")], "INCOMPLETE")


def present_count(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])


def quality_flag(checks: dict[str, Column]) -> Column:
    """INVALID_ and the name of the first check that fails, else VALID; a null check doesn't fail."""
    return first_match([(~check, f"INVALID_{name.upper()}") for name, check in checks.items()], "VALID")


def issue_count(checks: dict[str, Column]) -> Column:
    """How many checks fail."""
    return reduce(lambda a, b: a + b, [F.coalesce((~c).cast("int"), F.lit(0)) for c in checks.values()])


#: The metering model's thresholds and labels.
CONSUMPTION = [(0.1, "VERY_LOW"), (1.0, "LOW"), (10.0, "MEDIUM"), (50.0, "HIGH")]
DAILY_CONSUMPTION = [(1.0, "VERY_LOW"), (10.0, "LOW"), (50.0, "MEDIUM"), (100.0, "HIGH")]
TEMPERATURE = [(-10, "VERY_COLD"), (0, "COLD"), (10, "COOL"), (20, "MILD"), (30, "WARM"), (40, "HOT")]
HUMIDITY = [(30, "DRY"), (50, "COMFORTABLE"), (70, "MODERATE")]
QUALITY = [(90, "EXCELLENT"), (80, "GOOD"), (70, "FAIR")]
ANOMALY_SHARE = [(20, "HIGH_ANOMALY"), (10, "MEDIUM_ANOMALY")]
SEVERITY = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")]


def consumption_category(kwh: Column, steps: list[Bound] = CONSUMPTION) -> Column:
    return F.when(kwh == 0, F.lit("ZERO_CONSUMPTION")).otherwise(below(kwh, steps, "VERY_HIGH"))


def temperature_category(celsius: Column) -> Column:
    return F.when(celsius.isNull(), F.lit("UNKNOWN")).otherwise(below(celsius, TEMPERATURE, "VERY_HOT"))


def humidity_category(percent_: Column) -> Column:
    return F.when(percent_.isNull(), F.lit("UNKNOWN")).otherwise(below(percent_, HUMIDITY, "HUMID"))


def quality_tier(score: Column) -> Column:
    return at_least(score, QUALITY, "POOR")


def anomaly_classification(percent_: Column) -> Column:
    return F.when(percent_ >= 20, "HIGH_ANOMALY").when(percent_ >= 10, "MEDIUM_ANOMALY").when(percent_ > 0, "LOW_ANOMALY").otherwise("NO_ANOMALY")


def anomaly_severity(score: Column) -> Column:
    return at_least(score, SEVERITY, "MINIMAL")


def quality_distribution_tier(excellent: Column, good: Column, fair: Column) -> Column:
    """Of percentages of readings in each tier."""
    return first_match([(excellent >= 80, "EXCELLENT"), (good >= 70, "GOOD"), (fair >= 50, "FAIR")], "POOR")


def fair(column: Column, digits: int) -> Column:
    """Rounded half up, once what lies under a ten-billionth has been rounded away: binary noise moves no tie."""
    return F.round(column.cast("decimal(30,10)"), digits).cast("double")
