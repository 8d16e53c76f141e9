"""The near-copy mode of SimHash dedup: links are an exact Jaccard similarity of word shingles.

It goes the way of SimHash dedup first: each text's fingerprint, that of its different words, is dealt by its distances to
pivots, a table of pivot distances discards pairs, bits and shingles verify them, and components are made of the links
(`simhash.near_links`). Words, as a text with one of its words changed keeps all others but loses five shingles: texts of
similarity 0.8 or more differ in 3 bits then (median of 48 pairs of sf0.1), else in 9. Texts of common words are near by
these without being similar; the fingerprints of their shingles, which go along, differ in half the bits and keep them apart.

No radius holds all such texts, so an exact search follows for links between what is then still apart.

Two sets of similarity s or more share one of the first n - ceil(s * n) + 1 of their n shingles, in any order of
shingles that holds for all sets. The order here is that of the hashes, with shingles that a sample finds to be common
moved to the end (that order decides how much is compared, never what is found), so the cells in which partners meet (one
for each such shingle) are small. A cell is rows, never a list.

Each cell's members first meet a few leaders. Cells that still hold several components go on in rounds: some members
outside a cell's largest component meet all its members of other components and leave the cell, more of them each
round, until no cell holds two components. So pairs within a component are not made, and those of a cell never all at
once. Pairs are discarded, without losing a link,

* by their sizes, and by what of each set comes from a cell's shingle on: two sets whose first common shingle it is have
  no more in common than the smaller of these (those that share an earlier one meet there); cells that hold the
  same sets are one, and count from the earliest of their shingles;
* by a bitmap of each set, which holds for each of its bits whether an odd number of shingles fall on it: two bitmaps
  differ in no more bits than the sets in shingles.

What is left is verified by the shingles themselves. Sets are made again from the texts of those that have candidates, never kept for
all. A set is known by a 64-bit hash; among ten billion sets about three pairs are expected to share one.

A very long text costs its task some ten times its length in memory. A shingle that a third of all texts hold costs
rows in proportion, which joins can split; n texts of one template with similarities just below s cost n * n
comparisons, spread over rounds and tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.llm import simhash
from voltaic.llm._common import cut, drop_cut
from voltaic.llm.components import connected_components

SEED = 42
#: Common shingles: in COMMON_FROM sets or more of one in SAMPLE; they are marked in a filter of 2 ** FILTER_BITS bits.
SAMPLE, COMMON_FROM, FILTER_BITS = 16, 6, 23
#: Bits of a set's bitmap: twice its shingles, within these bounds.
LEAST_BITS, MOST_BITS = 128, 4096
#: Sizes of a smaller ratio meet the same leaders.
BAND = 1.25
#: Members of a cell that meet the others in the first round, how many times more in each next one, and at most.
MEET, MORE, MOST = 16, 8, 1024


def text_keys(text_col: str) -> dict[str, Column]:
    """t1 and t2, 128 bits that stand for a text; null as the empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("b"), text)}


def shingles(data: bytes, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; texts of fewer words are one shingle, those of none are empty."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    text, n, digest = b" ".join(words), len(words) - shingle + 1, xxhash.xxh64_intdigest
    if n < 2:
        return np.array([digest(text, SEED)], np.uint64).view(np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    h = np.fromiter((digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)), np.uint64, n)
    return np.unique(h.view(np.int64))


def word_hashes(data: bytes) -> np.ndarray:
    """The hashes of a text's different words."""
    words = set(data.lower().split())
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of which two similar sets share one; common ones (by a filter of bits) come last."""
    n = len(hashes)
    at = hashes & ((1 << FILTER_BITS) - 1)
    late = (common[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return np.concatenate([hashes[~late], hashes[late]])[: n - math.ceil(similarity * n - 1e-9) + 1]


def bitmap(hashes: np.ndarray) -> list[int]:
    """For each bit of some words of 64, whether an odd number of the set's shingles falls on it."""
    width = LEAST_BITS
    while width < min(MOST_BITS, 2 * len(hashes)):
        width *= 2
    return np.packbits(np.bincount(hashes & (width - 1), minlength=width).astype(np.uint8) & 1, bitorder="little").view("<i8").tolist()


def differing(a: Column, b: Column) -> Column:
    """In how many bits two bitmaps differ; one twice as wide as the other is folded."""

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    bits = F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def _different(keyed: DataFrame, make, schema: str) -> DataFrame:
    """make(t1, t2, sets) of each different text of a task; keyed holds text, t1, t2."""
    shingle_rows = keyed.select("text", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            for k in range(0, len(new), 256):
                part = batch.take(pa.array(new[k : k + 256], pa.int64()))
                texts = part.column(0).cast(pa.large_binary()).to_pylist()
                yield make(part.column(1), part.column(2), texts)

    return shingle_rows.mapInArrow(run, schema)


def _number(hashes: np.ndarray) -> int:
    """The 64-bit number that stands for a set of shingles."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _described(keyed: DataFrame, shingle: int) -> DataFrame:
    """(t1, t2, node, n, fp, second, bits) of every different text: fp is of its words, second of its shingles."""

    def make(t1, t2, texts):
        sets = [shingles(t, shingle) for t in texts]
        columns = [pa.array(list(map(f, sets)), kind) for f, kind in ((_number, pa.int64()), (len, pa.int32()), (bitmap, pa.list_(pa.int64())))]
        fps = [pa.array(list(map(fingerprint, hashes)), pa.int64()) for hashes in (map(word_hashes, texts), sets)]
        return pa.RecordBatch.from_arrays([t1, t2, *columns, *fps], ["t1", "t2", "node", "n", "bits", "fp", "second"])

    rows = _different(keyed, make, "t1 long, t2 long, node long, n int, bits array<long>, fp long, second long")
    return rows.groupBy("t1", "t2").agg(*(F.first(c).alias(c) for c in ("node", "n", "bits", "fp", "second")))


def _common(keyed: DataFrame, shingle: int) -> np.ndarray:
    """A filter of the shingles of many texts, by the texts of one key in SAMPLE."""

    def make(t1, t2, texts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, shingle) for t in texts]))], ["h"])

    some = _different(keyed.filter(F.pmod("t1", F.lit(SAMPLE)) == 0), make, "h long")
    often = some.groupBy("h").count().filter(F.col("count") >= COMMON_FROM)
    places = often.select(F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("at")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bits


def _cells(keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(h, node, n, rest): the sets that have h among the first of their shingles, and how many come from h on, where there are two sets
    at least. Of shingles that the same sets have one stands for all, with the largest rest.

    Nearly all shingles are of one set alone, so they are dealt by h once, which counting and joining both read, and are never written."""
    common = _common(keyed, shingle)

    def make(t1, t2, texts):
        sets = [s for t in texts if len(s := shingles(t, shingle))]
        parts = [prefix(s, common, similarity) for s in sets]
        again = np.array(list(map(len, parts)), np.int64)
        columns = [np.repeat(np.array(list(map(f, sets)), kind), again) for f, kind in ((_number, np.int64), (len, np.int32))]
        columns.append(columns[1] - np.concatenate([np.zeros(0, np.int32), *(np.arange(len(p), dtype=np.int32) for p in parts)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *parts])), *map(pa.array, columns)], ["h", "node", "n", "rest"])

    rows = _different(keyed, make, "h long, node long, n int, rest int")
    postings = rows.repartition("h").groupBy("h", "node").agg(F.first("n").alias("n"), F.first("rest").alias("rest"))
    same = [F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("b"), "node")).alias("s2"), F.min("node").alias("least")]
    shared = postings.groupBy("h").agg(*same).filter("members > 1")
    held = postings.join(shared, "h").groupBy("members", "s1", "s2", "least", "node")
    return cut(held.agg(F.min("h").alias("h"), F.first("n").alias("n"), F.max("rest").alias("rest")).select("h", "node", "n", "rest"), "cells")


def _fit(similarity: float) -> Column:
    """Whether sets of n and m shingles, of which rest and left come from their first common one on, can have the similarity."""
    sizes = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9
    return sizes & (F.least("rest", "left") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9)


def _near(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints are near by the pivots; those of one fingerprint meet its smallest."""
    named = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "second")).alias("x")).select("fp", F.col("x.node").alias("first"), "x.second"), "named")
    links = simhash.near_links(named)
    first = lambda c: named.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    pairs = links.join(first("a"), "a").join(first("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = nodes.select("node", "fp").join(named, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    out = cut(pairs.union(same).distinct(), "near")
    drop_cut(named, links)
    return out


def _stars(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of each cell's members with three leaders of their band of sizes and of the one below."""
    banded = cells.withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    own = F.struct("node", "n", "rest")
    leaders = banded.groupBy("h", "band").agg(F.array_distinct(F.array(F.min(own), F.max(own), F.min_by(own, F.xxhash64("node")))).alias("leads"))
    leaders = leaders.select("h", "band", F.explode("leads").alias("l")).select("h", "l", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    met = banded.join(leaders, ["h", "band"]).select("node", "n", "rest", F.col("l.node").alias("lead"), F.col("l.n").alias("m"), F.col("l.rest").alias("left"))
    met = met.filter(F.col("node") != F.col("lead")).filter(_fit(similarity))
    return met.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()


def _alike(n: Column, a: Column, b: Column, similarity: float) -> Column:
    """Whether bitmaps of sets of n shingles together differ in few enough bits for the similarity."""
    return differing(a, b) <= F.lit((1 - similarity) / (1 + similarity)) * n + 1e-9


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps differ in few enough bits."""
    side = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "bits")))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike(F.col("n_a") + F.col("n_b"), F.col("bits_a"), F.col("bits_b"), similarity))
    return near.select("a", "b")


def _sets(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, n, hashes) of the wanted (node), made from one text of each; nodes (node, t1, t2)."""

    def make(t1, t2, texts):
        sets = [shingles(t, shingle) for t in texts]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        columns = [pa.array(list(map(_number, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate(sets))]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "hashes"])

    keys = cut(nodes.join(wanted.select("node").distinct(), "node").select("t1", "t2"), "wanted")
    made = _different(keyed.join(keys, ["t1", "t2"]), make, "node long, n int, hashes array<long>")
    out = cut(made.groupBy("node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "sets")
    drop_cut(keys)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of similarity or more, by their shingles."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"hashes_{c}"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    enough = both >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - both) - 1e-9
    return cut(pairs.join(side("b"), "b").join(side("a"), "a").filter(enough).select("a", "b"), "similar")


def _labelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, root) after further links: these join roots, of which there are few, and only roots are searched."""
    if labels is None:
        return cut(connected_components(links), "labels")
    root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    merged = cut(connected_components(ends.filter("a <> b").distinct()), "merged")
    moved = labels.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    out = cut(moved.union(fresh), "labels")
    drop_cut(labels, merged)
    return out


def _open(cells: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, node, n, rest, root, main, bits) of cells that hold several components; main is the largest of them."""
    rooted = cells.join(labels, "node", "left").select("h", "node", "n", "rest", F.coalesce("root", "node").alias("root"))
    mains = rooted.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
    return cut(rooted.join(mains.filter("roots > 1").select("h", "main"), "h").join(nodes.select("node", "bits"), "node"), "open")


def near_copies(df: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(t1, t2, component) of every different text: the component of the texts reachable by links of similarity or more.

    Similarity is the Jaccard similarity of the sets of shingles, of lower-case words (ASCII). A null text counts as
    empty, and all texts without words are one component; repeated texts are one; other columns aren't read; an empty
    table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(text.alias("text"), *(c.alias(k) for k, c in text_keys(text_col).items()))
    texts = cut(_described(keyed, shingle), "texts")
    nodes = cut(texts.groupBy("node").agg(F.min_by(F.struct("t1", "t2", "n", "bits", "fp", "second"), F.struct("t1", "t2")).alias("x")).select("node", "x.*"), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = _sets(keyed, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), shingle)
        out = _similar(pairs.select("a", "b"), sets, similarity)
        drop_cut(sets)
        return out

    def apart(pairs: DataFrame) -> DataFrame:
        """Those whose ends are of different components so far."""
        root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return both.filter(~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b"))).select("a", "b")

    near = _near(nodes)
    possible = cut(_possible(near, nodes, similarity), "possible")
    links = verified(possible)
    labels = _labelled(None, links)
    drop_cut(near, possible, links)
    # the exact search for what no radius holds
    cells = _cells(keyed, shingle, similarity)
    stars = cut(_possible(apart(_stars(cells, similarity)), nodes, similarity), "stars")
    links = verified(stars)
    labels = _labelled(labels, links)
    drop_cut(stars, links)
    meet = MEET
    while True:
        several = _open(cells, labels, nodes)
        drop_cut(cells)
        if several.isEmpty():
            drop_cut(several)
            break
        turn = F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("node"), "node"))
        guests = several.filter("root <> main").select("h", "node", F.col("n").alias("m"), F.col("rest").alias("left"), F.col("root").alias("other"), F.col("bits").alias("own")).withColumn("turn", turn)
        guests = cut(guests.filter(F.col("turn") <= meet).withColumnRenamed("node", "guest").drop("turn"), "guests")
        # the bitmaps are compared within the join, so only pairs that may be similar become rows
        met = several.join(guests, "h").filter("root <> other").filter(_fit(similarity)).filter(_alike(F.col("n") + F.col("m"), F.col("bits"), F.col("own"), similarity))
        pairs = cut(met.select(F.least("guest", "node").alias("a"), F.greatest("guest", "node").alias("b")).distinct(), "pairs")
        links = verified(pairs)
        labels = _labelled(labels, links)
        # a guest has met all of its cell
        cells = cut(several.join(guests.select("h", F.col("guest").alias("node")), ["h", "node"], "left_anti").select("h", "node", "n", "rest"), "cells")
        drop_cut(several, guests, pairs, links)
        meet = min(MOST, meet * MORE)
    drop_cut(nodes)
    return texts.join(labels, "node", "left").select("t1", "t2", F.coalesce("root", "node").alias("component"))
