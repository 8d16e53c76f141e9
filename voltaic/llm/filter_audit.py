"""How quality filters interact, by a packed bitmap index.

Each partition holds one bitmap for each filter, for the two labels and for all rows, with the rows of a part side by side and each part
beginning at a new word of 64 bits. For each subset of the filters, AND-NOT leaves the rows that none of them rejects; their bits, counted for each part, are
added up over partitions. All that any order of the filters does follows from these counts, 2 ** filters a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm._common import cut

#: The filters, in the order of their bits. The last, E, looks at all rows; the others at a text alone.
FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_TRAILING = bytes(range(128, 192))  # UTF-8 bytes that don't begin a code point
_SIGNS = b"#$%&*|"


def failed(text: bytes) -> int:
    """Bits of the filters A to D that reject a text: few words, few different ones, many capitals, signs."""
    words = text.split()  # of bytes: at the six ASCII white-space characters
    few = len(words) < 200
    same = 100 * len(set(words)) < 50 * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    loud = 100 * capitals > 2 * len(text.translate(None, _TRAILING))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return few | same << 1 | loud << 2 | signs << 3


def _flags(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, t1, t2, bits) of every row: what its text fails, and 128 bits that stand for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<i8").reshape(-1, 2)
            bits = pa.array(list(map(failed, texts)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), bits], ["id", "part", "t1", "t2", "bits"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, t1 long, t2 long, bits int")


def subset_counts(parts: np.ndarray, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int = len(FILTERS)) -> tuple[np.ndarray, np.ndarray]:
    """The parts (numbers, ascending), and for each part and subset of the filters the rows that none of the subset
    rejects: all, good ones, toxic ones."""
    order = np.argsort(parts, kind="stable")
    names, begin, n = np.unique(parts[order], return_index=True, return_counts=True)
    words = (n + 63) >> 6
    first = np.cumsum(words) - words
    place = np.repeat(first << 6, n) + np.arange(len(order)) - np.repeat(begin, n)

    def packed(rows: np.ndarray) -> np.ndarray:
        wide = np.zeros(int(words.sum()) << 6, np.uint8)
        wide[place] = rows[order]
        return np.packbits(wide, bitorder="little").view(np.uint64)

    fails = [packed((bits >> k) & 1) for k in range(filters)]
    alive = {0: packed(np.ones(len(bits), np.uint8))}
    labels = (None, packed(good), packed(toxic))
    out = np.zeros((len(names), 1 << filters, 3), np.int64)
    for subset in range(1 << filters):
        if subset:
            k = subset.bit_length() - 1
            alive[subset] = alive[subset ^ 1 << k] & ~fails[k]
        for j, label in enumerate(labels):
            held = alive[subset] if label is None else alive[subset] & label
            if len(names):
                out[:, subset, j] = np.add.reduceat(np.bitwise_count(held).astype(np.int64), first)
    return names, out


def _counts(rows: DataFrame) -> DataFrame:
    """(part, subset, kept, kept_good, kept_toxic): for each part and subset, what it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            numbers, counts = subset_counts(part.indices.to_numpy(), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
            subsets = counts.shape[1]
            named = part.dictionary.take(pa.array(np.repeat(numbers, subsets)))
            columns = [named, pa.array(np.tile(np.arange(subsets, dtype=np.int32), len(numbers))), *(pa.array(counts[:, :, j].ravel()) for j in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "subset", "kept", "kept_good", "kept_toxic"])

    found = rows.select("part", "bits", "good", "toxic").mapInArrow(run, "part string, subset int, kept long, kept_good long, kept_toxic long")
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "kept_good", "kept_toxic")))


def _orders() -> Column:
    """All orders of the filters."""
    return F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order")


def _mask(letters: Column) -> Column:
    """The subset made of some letters."""
    return sum(((F.instr(letters, c) > 0).cast("int") * (1 << k) for k, c in enumerate(FILTERS)), F.lit(0))


def _removed(by: str, before: Column, bit: Column) -> Column:
    """What a filter removes of what a subset lets through, from the array of a part's counts."""
    at = lambda subset: F.get(F.col("counts"), subset)[by]
    return at(before) - at(before + bit)


def _shapley(k: int) -> Column:
    """What filter k removes, over all orders: of them |s|! (n - 1 - |s|)! have exactly the filters of s before it."""
    n, bit = len(FILTERS), 1 << k
    weight = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
    return sum((_removed("kept", F.lit(s), F.lit(bit)) * weight(s) for s in range(1 << n) if not s & bit), F.lit(0).cast("long"))


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    labels (id_col, quality, toxic): a document is good, or toxic, if any row of its id says 1. A null text counts as
    empty, a null part as the empty string. A null id has no label, is no smaller id and has none, so its row never
    fails E and makes no other row fail it; rows of one id and text don't make each other fail. Ids may repeat, each row counts by itself; further columns
    aren't read; an empty table gives no rows.
    """
    flags = cut(_flags(df, id_col, text_col, part_col), "flags")
    copies = flags.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("t1", "t2", "least")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(says("quality"), says("toxic"))
    repeated = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    marked = lambda c, name: F.coalesce(c, F.lit(False)).cast("tinyint").alias(name)
    last = 1 << (len(FILTERS) - 1)
    rows = flags.join(copies, ["t1", "t2"], "left").select("id", "part", (F.col("bits") + repeated * last).alias("bits")).join(marks, "id", "left")
    counts = _counts(rows.select("part", "bits", marked("quality", "good"), marked("toxic", "toxic")))
    whole = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "kept_good", "kept_toxic"))).alias("counts"))
    whole = cut(whole.withColumn("shapleys", F.array(*(_shapley(k) for k in range(len(FILTERS))))), "audit")  # a row for each part
    steps = whole.select("part", "counts", "shapleys", _orders()).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumns({"before": _mask(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "bit": _mask(own), "place": F.instr(F.lit(FILTERS), own)})
    removed = _removed("kept", F.col("before"), F.col("bit"))
    others = F.lit((1 << len(FILTERS)) - 1) - F.col("bit")
    return steps.select(
        "part", "filter_order", "step", F.get("counts", F.col("before") + F.col("bit"))["kept"].alias("kept"), removed.alias("removed"),
        (_removed("kept", F.lit(0), F.col("bit")) - removed).alias("redundant"), _removed("kept", others, F.col("bit")).alias("unique_fails"),
        _removed("kept_good", F.col("before"), F.col("bit")).alias("good_lost"), _removed("kept_toxic", F.col("before"), F.col("bit")).alias("toxic_lost"),
        F.get("shapleys", F.col("place") - 1).alias("shapley"),
    )


#: DuckDB SQL for the query.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
g AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * len(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > m.least, false)] AS fails
  FROM d JOIN m USING (text) LEFT JOIN g USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || e.x || h.x AS filter_order FROM letters a, letters b, letters c, letters e, letters h
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, h.x])) = 5),
steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS x, substr(filter_order, 1, s.step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
c AS (
  SELECT part, good, toxic, CASE WHEN fails[1] THEN 'A' ELSE '' END || CASE WHEN fails[2] THEN 'B' ELSE '' END || CASE WHEN fails[3] THEN 'C' ELSE '' END
    || CASE WHEN fails[4] THEN 'D' ELSE '' END || CASE WHEN fails[5] THEN 'E' ELSE '' END AS failing, count(*) AS n FROM f GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, x, contains(failing, x) AS fails_x, len(failing) = 1 AS alone, good, toxic, n,
    CASE WHEN before = '' THEN false ELSE regexp_matches(failing, '[' || before || ']') END AS gone FROM c, steps),
t AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT fails_x THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_x THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails_x THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_x AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_x AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_x AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL),
s AS (SELECT part, x, sum(removed) AS shapley FROM t GROUP BY ALL)
SELECT t.part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM t JOIN s ON t.part = s.part AND t.x = s.x
"""
