"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target divided by its size is the number of copies expected of each of its documents: the whole part is
certain. The rest, p, is shared out unequally, longer documents being likelier than short ones, which are left to fill
gaps: with z = size / (m + size) for the source's mean size m, and the mean of z over the source's words,
a document's inclusion probability is p + p (1 - p) (z - mean). It lies between 0 and 1, and the words expected are
those needed. Documents are ranked by their random odds divided by their inclusion odds, and each source takes its
ranking up to the words it needs: the sample's size is fixed in words, which is what targets are given in. What doesn't
fit is passed over, in ROUNDS rounds; then one document closes the gap. The cut through the
ranking is found by histograms of the rank (two levels of BUCKETS), so no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.llm._common import WORD, cut, drop_cut

BUCKETS = 1024
ROUNDS = 3
#: z in whole parts of this, so that sums are exact in any order.
PARTS = 1 << 16


def random_odds(column: Column, seed: int) -> Column:
    """u / (1 - u) for a number u in (0, 1) that depends on the value and the seed only."""
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return u / (1.0 - u)


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes (source, source_size) with target: the total shared by weight, none above cap times its size.

    Weights go round by the sources' order (nulls last). Sources are few rows, one each; they are ordered in one task.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    ranked = ranked.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "given": F.coalesce(F.sum("most").over(before), F.lit(0)), "gone_w": F.coalesce(F.sum("w").over(before), F.lit(0))})
    # a source is full if the level that is left for it and those with more room exceeds its own
    ranked = ranked.withColumn("full", (F.col("total") - F.col("given")) / (F.col("all_w") - F.col("gone_w")) > F.col("most") / F.col("w"))
    full = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(everything)
    ranked = ranked.withColumns({"given": full("most"), "gone_w": full("w")})
    level = F.try_divide(F.col("total") - F.col("given"), F.col("all_w") - F.col("gone_w"))
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("w")).alias("target"))


def _cut_at(parts: DataFrame, bucket: str) -> DataFrame:
    """parts (source, bucket, words, need): the bucket of each source in which its need ends, and the words before it."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    reached = parts.withColumn("upto", F.sum("words").over(w)).filter(F.col("upto") > F.col("need"))
    found = reached.groupBy("source").agg(F.min_by(F.struct(bucket, (F.col("upto") - F.col("words")).alias("before")), F.col(bucket)).alias("x"))
    return found.select("source", F.col(f"x.{bucket}").alias(f"cut_{bucket}"), F.col("x.before").alias(f"before_{bucket}"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _with(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their source's row."""
    return rows.join(sources, _same(rows, sources), how).drop(sources["source"])


#: The order of a ranking; the text's hash and the row's number tell rows apart that share all else.
RANK = ("q", "id", "size", "tie", "row")


def _take(ranked: DataFrame) -> DataFrame:
    """ranked (source, q, ..., b1, b2, need, drawn), with those drawn too with which the rest of the ranking, rows over
    the need left out, comes up to need."""
    open_rows = ranked.filter(F.col("q").isNotNull() & ~F.col("drawn") & (F.col("size") > 0) & (F.col("size") <= F.col("need")))
    first = cut(_cut_at(open_rows.groupBy("source", "b1").agg(F.sum("size").alias("words"), F.first("need").alias("need")), "b1"), "cut1")
    near = _with(open_rows, first).filter(F.col("b1") == F.col("cut_b1"))
    near = cut(near.withColumn("need", F.col("need") - F.col("before_b1")), "near")
    second = cut(_cut_at(near.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("need").alias("need")), "b2"), "cut2")
    last = _with(near, second).filter(F.col("b2") == F.col("cut_b2"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(*RANK).rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).filter(F.col("upto") <= F.col("need") - F.col("before_b2"))
    last = last.groupBy("source").agg(F.max(F.struct(*RANK)).alias("last_in"))
    bounds = cut(_with(_with(first, second, "left"), last, "left"), "bounds")
    here = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2"))
    before = (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2")))
    within = F.col("cut_b1").isNull() | before | (here & F.coalesce(F.struct(*RANK) <= F.col("last_in"), F.lit(False)))
    fits = F.col("q").isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col("need"))
    out = cut(_with(ranked, bounds, "left").withColumn("drawn", F.col("drawn") | (fits & within)).select(ranked.columns), "ranked")
    drop_cut(first, near, second, bounds)
    return out


def mix_sources(
    df: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, seed: int = 7,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple = (),
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every document, and its columns named in keep.

    size: words of the text (null: 0). copies: how often the mix takes the document, from 0 to cap; taken = copies *
    size. After the whole copies and the sampled ones, each source takes the one document whose size comes nearest
    to the words still missing, if that helps; so a source misses its target by less than any document can mend.
    Each row counts by itself, repeated ones too: of rows alike in all, as many are taken as are needed. A null source is a source of its own, a null id
    a value like others; empty texts take nothing; an empty table gives an empty one. Equal inputs and seeds give
    equal results.
    """
    kept = {f"keep_{k}": F.col(c) for k, c in enumerate(keep)}
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.select(F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in kept.items()), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"))
    sized = cut(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    means = cut(sums.select("source", "source_size", F.expr("source_size div greatest(n, 1)").alias("mean_size")), "means")
    z = F.expr(f"({PARTS} * size) div greatest(mean_size + size, 1)")
    tilts = _with(sized, means).groupBy("source").agg(F.sum(z * F.col("size")).alias("z_words"))
    targets = cut(_with(_with(source_targets(means.select("source", "source_size"), weights, cap), means.drop("source_size")), tilts), "targets")

    total = F.col("source_size").cast("double")
    ranked = _with(sized, targets).withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), total)), F.lit(0)))
    ranked = ranked.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    p = F.try_divide(F.col("need"), total)
    chance = p + p * (1.0 - p) * ((z - F.col("z_words") / total) / float(PARTS))
    ranked = ranked.withColumn("q", F.when(p > 0, random_odds(F.col("id"), seed) / (chance / (1.0 - chance))))
    at = F.col("q") / (1.0 + F.col("q")) * BUCKETS
    ranked = ranked.withColumns({"b1": F.least(F.floor(at), F.lit(BUCKETS - 1)).cast("int"), "b2": F.least(F.floor((at - F.floor(at)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")})
    ranked = ranked.withColumn("drawn", F.lit(False)).drop("mean_size", "z_words")
    ranked = cut(ranked, "ranked")
    for _ in range(ROUNDS):
        taken = _take(ranked)
        drop_cut(ranked)
        got = taken.groupBy("source").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("got"), F.first("whole").alias("w"), F.first("target").alias("t"), F.first("source_size").alias("s"))
        gaps = cut(got.select("source", (F.col("t") - F.col("w") * F.col("s") - F.col("got")).alias("gap")), "gaps")
        ranked = _with(taken, gaps).withColumn("need", F.col("gap")).drop("gap")

    left = ranked.filter(~F.col("drawn") & F.col("q").isNotNull() & (F.col("size") > 0))
    miss = F.abs(F.col("need") - F.col("size"))
    closing = left.filter(miss < F.col("need")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), *RANK)).alias("c"))
    closing = cut(closing.select("source", F.col("c.row").alias("c_row")), "closing")
    out = _with(ranked, closing, "left")
    copies = F.col("whole") + (F.col("drawn") | F.coalesce(F.col("row") == F.col("c_row"), F.lit(False))).cast("long")
    extra = [F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *extra)


#: DuckDB SQL for the query's columns, with the production parameters.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
srcs AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (
  SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) AS w, 3 * source_size AS most FROM srcs),
rooms AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    CAST(coalesce(sum(most) OVER r, 0) AS BIGINT) AS given, CAST(coalesce(sum(w) OVER r, 0) AS BIGINT) AS gone_w
  FROM turns WINDOW r AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fulls AS (SELECT *, (total - given) / (all_w - gone_w) > most / w AS is_full FROM rooms),
levels AS (
  SELECT *, CAST(sum(CASE WHEN is_full THEN most ELSE 0 END) OVER () AS BIGINT) AS g, CAST(sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS BIGINT) AS gw FROM fulls),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE (total - g) / nullif(all_w - gw, 0) * w END AS target FROM levels),
exp_copies AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS BIGINT) AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
needs AS (SELECT *, target - whole * source_size AS need, (target - whole * source_size) / nullif(source_size, 0) AS p,
  (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
  row_number() OVER () AS nr, source_size // greatest(count(*) FILTER (size > 0) OVER (PARTITION BY source), 1) AS mean_size FROM exp_copies),
zs AS (SELECT *, (65536 * size) // greatest(mean_size + size, 1) AS z FROM needs),
means AS (SELECT *, CAST(sum(z * size) OVER (PARTITION BY source) AS DOUBLE) / nullif(source_size, 0)::DOUBLE AS z_mean FROM zs),
chances AS (SELECT *, p + p * (1.0::DOUBLE - p) * ((z - z_mean) / 65536.0::DOUBLE) AS chance FROM means),
odds0 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (chance / (1.0::DOUBLE - chance)) END AS q, false AS drawn0, need AS gap0 FROM chances),
"""

#: A round: what still fits, in the ranking's order, up to the words still needed.
SQL += "".join(
    f"""fit{k} AS (SELECT *, q IS NOT NULL AND NOT drawn{k} AND size > 0 AND size <= gap{k} AS fits{k} FROM odds{k}),
upto{k} AS (SELECT *, sum(CASE WHEN fits{k} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size, nr ROWS UNBOUNDED PRECEDING) AS words{k} FROM fit{k}),
draw{k} AS (SELECT *, drawn{k} OR (fits{k} AND words{k} <= gap{k}) AS drawn{k + 1} FROM upto{k}),
odds{k + 1} AS (SELECT *, need - sum(CASE WHEN drawn{k + 1} THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap{k + 1} FROM draw{k}),
"""
    for k in range(ROUNDS)
)
SQL += f"""misses AS (SELECT *, CASE WHEN NOT drawn{ROUNDS} AND q IS NOT NULL AND size > 0 AND abs(gap{ROUNDS} - size) < gap{ROUNDS} THEN abs(gap{ROUNDS} - size) END AS miss FROM odds{ROUNDS}),
closing AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss NULLS LAST, q, doc_id, size, nr) AS r FROM misses)
SELECT doc_id, size, source_size, target,
  (whole + CASE WHEN drawn{ROUNDS} OR (miss IS NOT NULL AND r = 1) THEN 1 ELSE 0 END) * size AS taken
FROM closing
"""
