"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks of queries and candidates.

A dimension is a term, its non-zero components are postings. In each pair of blocks every query adds, term by term,
its weight times the postings to a dense array of scores; each query's best rows are then selected by partition,
and the few rows a block yields are merged by a window. Blocks have a bounded number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.llm._common import cut

_LARGEST = (1 << 63) - 1


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros; (dims, rows)."""
    out = np.zeros((len(column), dims), np.int64)
    flat = column.combine_chunks()
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(out.T)


def scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], rows: int, dtype) -> np.ndarray:
    """(queries, rows): queries is (terms, queries); postings: of each term, the rows that hold it and their values."""
    out = np.zeros((queries.shape[1], rows), dtype)
    part = np.empty_like(out) if dtype is not object else None
    for weights, (at, values) in zip(queries, postings, strict=True):
        asking = np.flatnonzero(weights)
        if not len(asking) or not len(at):
            continue
        if dtype is not object and len(asking) == len(weights) and len(at) == rows:
            np.multiply(weights[:, None], values[None, :], out=part)
            out += part
        else:
            out[asking[:, None], at[None, :]] += weights[asking, None] * values[None, :]
    return out


def best(queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, place of the row and score for each query's k best rows but its own, ties to earlier rows.
    queries and rows are (terms, n)."""
    bound = len(queries) * int(np.abs(queries.astype(object)).max(initial=0)) * int(np.abs(rows.astype(object)).max(initial=0)) if queries.size and rows.size and (queries.min() == -(1 << 63) or rows.min() == -(1 << 63)) else len(queries) * int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0))
    dtype = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    queries, rows = queries.astype(dtype), rows.astype(dtype)
    postings = [(at := np.flatnonzero(r), r[at]) for r in rows]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(row_numbers)
    for first in range(0, len(query_rows), 64):
        block = slice(first, first + 64)
        s = scores(np.ascontiguousarray(queries[:, block]), postings, len(row_numbers), dtype)
        if dtype is object:
            s = np.clip(s, -_LARGEST, _LARGEST).astype(np.int64)
        never = np.iinfo(s.dtype).min
        own = np.searchsorted(row_numbers, query_rows[block], sorter=order)
        for i, (q, at) in enumerate(zip(query_rows[block].tolist(), own.tolist(), strict=True)):
            if at < len(order) and row_numbers[order[at]] == q:
                s[i, order[at]] = never
        n = min(k, len(row_numbers))
        least = np.partition(s, len(row_numbers) - n, axis=1)[:, len(row_numbers) - n]
        for i in range(s.shape[0]):
            above = np.flatnonzero(s[i] > least[i])
            ties = np.flatnonzero(s[i] == least[i])[: n - len(above)]
            at = np.concatenate([above, ties])
            at = at[s[i, at] > never]
            found.append((np.full(len(at), first + i), at, s[i, at].astype(np.int64)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[j] for f in found]) if found else none for j in range(3))  # type: ignore[return-value]


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 2048, candidate_rows: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest inner product of floor(scale * x), for each row whose
    id is divisible by every, ties to smaller ids.

    Vectors null or with null or non-finite components, and rows with a null id, take no part; each row counts by
    itself, so of rows that share an id each is a candidate, for the others too, and each a query; a shorter vector counts as filled up with zeros; scores beyond 64 bits
    stop at the largest; empty vectors score 0. Fewer than k other rows: all of them. No valid rows: no rows.
    """
    x = F.col(vector_col)
    valid = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    rows = df.filter(F.col(id_col).isNotNull() & valid).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), whole.alias("v"))
    rows = cut(rows, "vectors")
    asking = F.col("id") % every == 0
    n, asked, dims = rows.agg(F.count("*"), F.count(F.when(asking, 1)), F.max(F.size("v"))).first()
    query_blocks, row_blocks = max(1, -(-asked // query_rows)), max(1, -(-n // candidate_rows))
    block = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    copies = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.filter(asking).select("id", "row", "v", block(query_blocks).alias("qb"), copies(row_blocks).alias("rb"))
    candidates = rows.select("id", "row", "v", block(row_blocks).alias("rb"), copies(query_blocks).alias("qb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r, found = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            right = right.sort_by([("id", "ascending"), ("row", "ascending")])
            numbers = [t["row"].to_numpy() for t in (left, right)]
            q, r, found = best(_matrix(left["v"], dims or 0), numbers[0], _matrix(right["v"], dims or 0), numbers[1], k)
        columns = [left["id"].take(pa.array(q)), left["row"].take(pa.array(q)), right["id"].take(pa.array(r)), right["row"].take(pa.array(r)), pa.array(found)]
        return pa.table(columns, ["query_id", "query_row", "id", "row", "score"])

    found = queries.groupBy("qb", "rb").cogroup(candidates.groupBy("qb", "rb")).applyInArrow(search, "query_id long, query_row long, id long, row long, score long")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


#: DuckDB SQL for the query, with the production parameters.
SQL = """
WITH parts AS (
  SELECT vec_id, nr, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM (SELECT *, row_number() OVER () AS nr FROM embeddings) WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT nr FROM parts WHERE x IS NULL OR NOT isfinite(x)),
e AS (SELECT vec_id, nr, i, CAST(floor(256.0::DOUBLE * x) AS BIGINT) AS x FROM parts WHERE nr NOT IN (SELECT nr FROM bad)),
s AS (
  SELECT q.vec_id AS query_id, q.nr AS qn, c.vec_id, c.nr AS cn, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.nr <> c.nr WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id, cn) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
