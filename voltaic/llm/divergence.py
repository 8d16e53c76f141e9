"""How far the sources of a language differ in what words they use, relationally.

Matches are exploded and counted by group (language and source); languages keep the terms of several documents; groups
are crossed with their language's kept terms, so that what a group lacks counts as zero; a self-join on language and term
compares the groups, and windows rank them. All in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.llm._common import cut, shuffle_partitions

#: What stands between terms: all ASCII characters but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shares are parts of this many.
WHOLE = 1_000_000_000
#: Counts up to here can be multiplied by WHOLE in 64 bits.
_NARROW = 9_000_000_000


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + terms)), exact for all counts of 64 bits."""
    over = total + terms
    narrow = F.call_function("div", (n + 1) * F.lit(WHOLE), over)
    wide = F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(WHOLE).cast("decimal(10,0)"), over.cast("decimal(19,0)"))
    return F.when(n < _NARROW, narrow).otherwise(wide) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _counted(base: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term, in one pass over the texts.

    The outer explodes keep Catalyst from splitting the text once more to see whether there is anything to explode.
    """
    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    split = base.select("lang", "source", F.split(lower, BETWEEN).alias("terms"))
    part = lambda terms, n, docs: F.struct(terms.alias("terms"), F.lit(n).alias("n"), F.lit(docs).alias("docs"))
    both = F.array(part(F.col("terms"), 1, 0), part(F.array_distinct("terms"), 0, 1))
    rows = split.select("lang", "source", F.explode_outer(both).alias("x")).select("lang", "source", "x.n", "x.docs", F.explode_outer("x.terms").alias("term"))
    return rows.filter("term <> ''").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" holds a group's distance from each other source of its
    language, part "term" the terms that it uses more than its language does, the top ones.

    Null texts, languages and sources count as ''. Every row is a document, repeated ones too; other columns aren't read. A language without
    kept terms gives its pairs the value 0; an empty table gives no rows.

    A row of the table of terms holds its counts by source, so it grows with the number of sources of a language, as the
    result does; rows are dealt by term, so neither a hot source nor a hot language is one task's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source")
    terms = _counted(base).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), by_source)
    terms = cut(terms.filter(F.col("docs") >= min_docs).select("lang", "term", "in_lang", "by_source"), "terms")
    totals = terms.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    groups = base.groupBy("lang", "source").agg(F.lit(0).alias("zero")).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total"))), "groups")

    salts = shuffle_partitions(df.sparkSession)
    salted = groups.filter("terms > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dense = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"])
    n = F.coalesce(F.try_element_at("by_source", F.col("source")), F.lit(0).cast("long"))
    dense = dense.select("lang", "term", "source", n.alias("n"), "total", "terms", "in_lang", "lang_total").withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    side = lambda s: dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"))
    both = side("a").join(side("b"), ["lang", "term"]).filter("a < b")
    sums = both.groupBy("lang", "a", "b").agg(F.sum(distance(F.col("p_a"), F.col("p_b"))).alias("ab"), F.sum(distance(F.col("p_b"), F.col("p_a"))).alias("ba"))
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    pairs = sums.select("lang", F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("x")).select("lang", "x.*")
    bare = groups.filter("terms = 0").select("lang", "source")
    others = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    above = dense.filter("n > 0").withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return ranked(pairs.unionByName(others), "pair").unionByName(ranked(above, "term").filter(F.col("rank") <= top))


#: DuckDB SQL for the query.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM d),
kept AS (SELECT lang, term FROM docs GROUP BY ALL HAVING count(*) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM dense),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY ALL),
q AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM l),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
above AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM every UNION ALL FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
