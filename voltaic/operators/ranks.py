"""Running sums over sorted values and exact quantiles, without one task that sorts or holds them all.

Values are dealt to cells between approximate quantiles, sums run within each cell, and each cell adds what all lower
cells hold. Results are exact wherever the cells' bounds lie.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import steps

#: Cells at least, and for each shuffle partition; the window over the cells' totals holds one row each.
CELLS, EACH = 128, 4


def _lower(bounds: str, x: str, cells: int) -> Column:
    """How many of the ascending bounds, fewer than cells, are under x; found by halving, so many cells cost a row few steps."""
    further = lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) < F.col(x), F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(cells.bit_length()))]), F.lit(0), further)


def _celled(df: DataFrame, x: str, cells: int | None) -> DataFrame:
    """df with _cell, ascending with x. Without a number of cells they follow the shuffle partitions, as the rows a task sorts should."""
    cells = cells or max(CELLS, EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.agg(F.percentile_approx(x, F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(10 * cells)).alias("_bounds"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("_cell", _lower("_bounds", x, cells)).drop("_bounds")  # bounds is one row


def running(df: DataFrame, x: str, sums: list[str], cells: int | None = None) -> DataFrame:
    """df, in which the values x differ and aren't null, with before_<c>, the sum of c over all rows of lower x, for
    each of sums, and next_x, the next higher x."""
    celled = _celled(df, x, cells)
    totals = celled.groupBy("_cell").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums], F.min(x).alias("_least"))
    lower = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_cell", *[F.coalesce(F.sum(f"_all_{c}").over(lower), F.lit(0)).alias(f"_lower_{c}") for c in sums], F.lead("_least").over(Window.orderBy("_cell")).alias("_least"))
    inner = Window.partitionBy("_cell").orderBy(x)
    before = {f"before_{c}": F.coalesce(F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}
    out = celled.withColumns(before | {"next_x": F.lead(x).over(inner)}).join(F.broadcast(totals), "_cell")  # totals has a row a cell
    out = out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_lower_{c}") for c in sums} | {"next_x": F.coalesce("next_x", "_least")})
    return out.drop("_cell", "_least", *[f"_lower_{c}" for c in sums])


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, q: the exact quantiles of the column, interpolated between neighbours; nulls don't count."""
    values = df.select(F.col(column).alias("x")).filter("x is not null")
    counted = steps.cut(values.groupBy("x").agg(F.count("*").alias("n")))  # bounds, cells and sums read it, not the input
    celled, n = _celled(counted, "x", None), F.col("_n")
    ends = [end((n - 1) * share) for share in shares for end in (F.floor, F.ceil)]
    totals = celled.groupBy("_cell").agg(F.sum("n").alias("_all"))
    lower = F.coalesce(F.sum("_all").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_cell", "_all", lower.alias("_lower"), F.sum("_all").over(Window.partitionBy()).alias("_n"))
    wanted = totals.filter(reduce(or_, [(F.col("_lower") <= end) & (end < F.col("_lower") + F.col("_all")) for end in ends]))
    inner = Window.partitionBy("_cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    # only the cells in which the quantiles lie, two a share at most, are sorted
    counts = celled.join(F.broadcast(wanted), "_cell").withColumn("before_n", F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("_lower"))
    held = lambda place: F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("x")))
    parts: list[Column] = []
    for i, share in enumerate(shares):
        place = (n - 1) * share
        parts += [held(F.floor(place)).alias(f"lo{i}"), held(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"part{i}")]
    row = counts.agg(*parts)
    return row.select(F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}") for i in range(len(shares))]).alias("q"))


def decay_rows(alpha: float, least: float = 1e-17) -> int:
    """After how many rows an exponential weight is under least: what lies further back is lost in a double's rounding."""
    return math.ceil(math.log(least) / math.log(1 - alpha)) if 0 < alpha < 1 else 1
