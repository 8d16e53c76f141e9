"""Comparisons by name, as rules and searches state them. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "contains": lambda c, v: c.contains(v),
    "regex": lambda c, v: c.rlike(v),
}


def compare(column: Column, operator: str, value) -> Column:
    """Whether the column stands to value as operator says; a null doesn't, and any unknown operator holds."""
    if operator not in COMPARISONS:
        return F.lit(True)
    return F.coalesce(COMPARISONS[operator](column, value), F.lit(False))
