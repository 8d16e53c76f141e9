"""Joins by key and time. Ranges become buckets that join by equality, so no plan compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import steps


def seconds(ts: str) -> Column:
    """Seconds of a timestamp without zone, with fractions."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: float, how: str = "inner") -> DataFrame:
    """Pairs of equal keys at most within seconds apart; how: inner, left, right or full.

    Key columns come from both sides under the names of the left; other column names must differ. The right rows are
    entered in three buckets of the interval's width, so a hot key is spread over time.
    """
    bucket = lambda ts: F.floor(seconds(ts) / within).cast("long")
    a = left.withColumn("_bucket", bucket(left_ts))
    b = right.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)}).drop(*keys)
    b = b.withColumn("_near", F.explode(F.array(*[bucket(right_ts) + d for d in (-1, 0, 1)])))
    same = (F.col("_bucket") == F.col("_near")) & (F.abs(seconds(left_ts) - seconds(right_ts)) <= within)
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_k{i}")
    drops = ["_bucket", "_near", *(f"_k{i}" for i in range(len(keys)))]
    if how in ("inner", "left"):
        return a.join(b, same, how).drop(*drops)
    out = a.join(b, same, "inner").drop(*drops)
    lonely = _without_partner(right, left.select(*keys, F.col(left_ts).alias("_ts")), keys, right_ts, within)
    out = out.unionByName(lonely, allowMissingColumns=True)
    if how == "full":
        alone = _without_partner(left, right.select(*keys, F.col(right_ts).alias("_ts")), keys, left_ts, within)
        out = out.unionByName(alone, allowMissingColumns=True)
    return out


def _without_partner(df: DataFrame, others: DataFrame, keys: list[str], ts: str, within: float) -> DataFrame:
    """Rows of df without a row of others (keys, _ts) nearby; these are entered in three buckets of time, as above."""
    bucket = lambda c: F.floor(seconds(c) / within).cast("long")
    a = df.withColumn("_bucket", bucket(ts))
    b = others.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_ts", F.explode(F.array(*[bucket("_ts") + d for d in (-1, 0, 1)])).alias("_near"))
    test = (F.col("_bucket") == F.col("_near")) & (F.abs(seconds(ts) - seconds("_ts")) <= within)
    for i, k in enumerate(keys):
        test &= F.col(k) == F.col(f"_k{i}")
    return a.join(b, test, "left_anti").drop("_bucket")


def key_window_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, window: str) -> DataFrame:
    """All pairs of a key's rows that fall into the same tumbling window: the cross join within a key's buffer."""
    a = left.withColumn("window_start", F.window(left_ts, window)["start"])
    b = right.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)} | {"_start": F.window(right_ts, window)["start"]}).drop(*keys)
    test = F.col("window_start") == F.col("_start")
    for i, k in enumerate(keys):
        test &= F.col(k) == F.col(f"_k{i}")
    return a.join(b, test).drop("_start", *[f"_k{i}" for i in range(len(keys))])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """Each left row with the right value of the latest time not after its own: one union and one window, no join."""
    a = left.select(*left.columns, F.col(left_ts).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_t", "_v", "_side")


#: Halvings of the places' square: cells at the last level are its side over 2 ** LEVELS wide; BY are made at a time.
LEVELS, BY = 24, 2


def nearest(facts: DataFrame, places: DataFrame, lat: str, lon: str, key: str) -> DataFrame:
    """Each fact location with the key of its nearest place, in degrees; ties go to the smaller key. Facts without a location are left out.

    Cells are searched from coarse to fine. A spot keeps the cells whose box of places may hold its nearest one: those not
    farther at best than another is at worst. Their parts follow, until each cell kept is one location. So crowded places cost
    a level more, not a comparison each; one round a level, written. What the last level leaves together is compared place by place.
    """
    point = [F.col(c).cast("double") for c in (lat, lon)]
    named = places.select(point[0].alias("_lat"), point[1].alias("_lon"), F.col(key).alias("_key")).filter("_lat is not null and _lon is not null")
    others = steps.cut(named.groupBy("_lat", "_lon").agg(F.min("_key").alias("_key")))
    low_lat, high_lat, low_lon, high_lon = others.agg(F.min("_lat"), F.max("_lat"), F.min("_lon"), F.max("_lon")).first()
    if low_lat is None:
        return facts.limit(0).withColumns({f"nearest_{key}": F.lit(None).cast(places.schema[key].dataType), "distance": F.lit(None).cast("double")})
    side = max(high_lat - low_lat, high_lon - low_lon, 1e-9) * (1 + 1e-9)
    finest = lambda c, low: F.floor((F.col(c) - low) / side * 2**LEVELS).cast("long")
    others = steps.cut(others.withColumns({"_x": finest("_lat", low_lat), "_y": finest("_lon", low_lon)}))
    spots = facts.select(lat, lon).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).distinct()
    open_ = steps.cut(spots.withColumns({"_x": F.lit(0).cast("long"), "_y": F.lit(0).cast("long")}))
    box = [F.min("_lat").alias("a"), F.max("_lat").alias("b"), F.min("_lon").alias("c"), F.max("_lon").alias("d"), F.min("_key").alias("_key")]
    gap = lambda low, high, x: F.greatest(F.lit(0.0), F.col(low) - F.col(x), F.col(x) - F.col(high))
    far = lambda low, high, x: F.greatest(F.col(high) - F.col(x), F.col(x) - F.col(low))
    square = lambda f: F.pow(f("a", "b", lat), F.lit(2)) + F.pow(f("c", "d", lon), F.lit(2))
    done = None
    for level in range(BY, LEVELS + 1, BY):
        shift = LEVELS - level
        cells = others.groupBy(F.shiftright("_x", shift).alias("_cx"), F.shiftright("_y", shift).alias("_cy")).agg(*box)
        cells = cells.withColumns({"_x": F.shiftright("_cx", BY), "_y": F.shiftright("_cy", BY)})
        met = open_.join(cells, ["_x", "_y"]).select(lat, lon, "_cx", "_cy", square(gap).alias("_least"), square(far).alias("_most"), "_key", ((F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))).alias("_one"))
        met = steps.cut(met)
        kept = met.join(met.groupBy(lat, lon).agg(F.min("_most").alias("_bound")), [lat, lon]).filter(F.col("_least") <= F.col("_bound"))
        ended = kept.groupBy(lat, lon).agg(F.every("_one").alias("_ended"), F.min(F.struct("_least", "_key")).alias("_b"))
        ended = steps.cut(ended)
        found = ended.filter("_ended").select(lat, lon, "_b")
        done = found if done is None else done.unionByName(found)
        open_ = steps.cut(kept.join(ended.filter("not _ended").select(lat, lon), [lat, lon]).select(lat, lon, F.col("_cx").alias("_x"), F.col("_cy").alias("_y")))
        if open_.isEmpty():
            break
    else:
        last = open_.join(others, ["_x", "_y"]).withColumns({"a": F.col("_lat"), "b": F.col("_lat"), "c": F.col("_lon"), "d": F.col("_lon")})
        done = done.unionByName(last.groupBy(lat, lon).agg(F.min(F.struct(square(gap).alias("_least"), "_key")).alias("_b")))
    return facts.join(done, [lat, lon]).withColumns({f"nearest_{key}": F.col("_b._key"), "distance": F.sqrt("_b._least")}).drop("_b")


def close_counts(df: DataFrame, key: str, lat: str, lon: str, reach: float) -> DataFrame:
    """(key, close): how many rows of other keys are under reach degrees from each row with a key; rows without any are left out. Keys may repeat.

    Equal places are compared once, with the number of their rows, so rows that share a place cost no pairs.
    """
    rows = df.select(key, lat, lon).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(key).isNotNull())
    own = rows.groupBy(key, lat, lon).agg(F.count("*").alias("_n"))
    spots = steps.cut(own.groupBy(lat, lon).agg(F.sum("_n").alias("_n")).withColumn("_spot", F.monotonically_increasing_id()))
    met = within_distance(spots, "_spot", lat, lon, reach)
    other = spots.select(F.col("_spot").alias("other"), F.col("_n").alias("_m"))
    around = met.join(other, "other").groupBy("_spot").agg(F.sum("_m").alias("_around"))
    spots = steps.cut(spots.join(around, "_spot", "left").select("_spot", lat, lon, (F.col("_n") + F.coalesce("_around", F.lit(0))).alias("_all")))
    placed = own.join(spots, [lat, lon])
    several = own.groupBy(key).agg(F.count("*").alias("_k")).filter("_k > 1").select(key)
    # a key of one place is left out of its own count there; one of several places, at each of them that is near
    alone = placed.join(several, key, "left_anti").select(key, (F.col("_n") * (F.col("_all") - F.col("_n"))).alias("close"))
    many = placed.join(several, key).select(key, lat, lon, "_n", "_all")
    mine = many.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.col("_n").alias("_m"))
    near = F.sqrt(F.pow(F.col(lat) - F.col("_lat"), F.lit(2)) + F.pow(F.col(lon) - F.col("_lon"), F.lit(2))) < reach
    apart = many.join(mine, key).groupBy(key, lat, lon).agg(F.first("_n").alias("_n"), F.first("_all").alias("_all"), F.sum(F.when(near, F.col("_m")).otherwise(0)).alias("_own"))
    summed = apart.groupBy(key).agg(F.sum(F.col("_n") * (F.col("_all") - F.col("_own"))).alias("close"))
    return alone.unionByName(summed).filter("close > 0")


def within_distance(df: DataFrame, key: str, lat: str, lon: str, reach: float) -> DataFrame:
    """(key, other) of different rows under reach degrees apart, both ways. Cells of that width join by equality; each row is
    entered in nine, so the join is told not to send them through the driver."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    places = df.select(key, lat, lon).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"_x": cell(lat), "_y": cell(lon)})
    steps = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    others = places.select(F.col(key).alias("other"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), "_x", "_y", F.explode(steps).alias("_d"))
    others = others.select("other", "_lat", "_lon", (F.col("_x") + F.col("_d.x")).alias("_x"), (F.col("_y") + F.col("_d.y")).alias("_y"))
    distance = F.sqrt(F.pow(F.col(lat) - F.col("_lat"), F.lit(2)) + F.pow(F.col(lon) - F.col("_lon"), F.lit(2)))
    return places.hint("merge").join(others.hint("merge"), ["_x", "_y"]).filter((F.col(key) != F.col("other")) & (distance < reach)).select(key, "other")
