"""SimHash near-duplicates with pivot distance tables.

Fingerprints within MAX_BITS differing bits link. The 64 bits fall into parts, and every part has reference fingerprints
(pivots); a fingerprint's coordinates are its Hamming distances to them on that part. Pivots are a random pattern and
all that differ from it in one bit, so coordinates tell all patterns of a part apart. Two fingerprints that link have
equal coordinates on all parts but MAX_BITS: these are the cells through which pairs are dealt and sought. Within a cell
a table of distances to pivots of all 64 bits discards every pair with a coordinate difference over MAX_BITS, and the
survivors are verified. Only links of a spanning forest of each cell leave it: a fingerprint that is reached is compared
with those not yet reached.

A cell leaves at most 22 bits open, so it holds 2 ** 22 different fingerprints at most, whatever the size of the corpus.
One of more than LARGE is dealt once more: its open bits fall into parts with pivots of their own, which leaves cells of
8 open bits, 256 fingerprints at most, one task's work each.

near_links does the same for a wider radius, which the pipeline's near copies need: there fewer parts must agree, and
second fingerprints discard pairs that only the first ones bring together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm._common import cut, drop_cut
from voltaic.llm.components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Widths of the parts, 64 bits together. A cell of more fingerprints than LARGE is dealt once more, by so many parts of its open bits.
PARTS, LARGE, FINER = (11, 11, 11, 11, 10, 10), 4096, 6
#: The wider radius, on how many parts fingerprints agree that meet for it, and the radius of second fingerprints.
RADIUS, AGREE, SECOND = 8, 2, 20
#: A cell of more for the wider radius is dealt to parts.
CROWD = 256
#: Pivots of all bits. Pairs of cells up to SMALL are compared many cells at once.
PIVOTS, SMALL = 24, 64
_RNG = np.random.default_rng(64)
_REFERENCES = _RNG.integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
#: The parts on which two linked fingerprints agree, for each choice; factors make one number of their coordinates.
_CHOICES = list(combinations(range(len(PARTS)), len(PARTS) - MAX_BITS))
_FINER = list(combinations(range(FINER), FINER - MAX_BITS))
_WIDER = list(combinations(range(len(PARTS)), AGREE))
_FACTORS = _RNG.integers(0, 1 << 63, (max(len(_CHOICES), len(_FINER), len(_WIDER)), max(len(PARTS), FINER)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 64, dtype=np.uint64))


def _masks(bits: list[int], widths: list[int]) -> list[list[int]]:
    """The bits, dealt to parts of these widths."""
    ends = list(accumulate(widths))
    return [bits[end - width : end] for width, end in zip(widths, ends, strict=True)]


#: The bits of each part; and of each choice's open bits, the finer parts.
_PART_BITS = _masks(list(range(64)), list(PARTS))
_OPEN_BITS = []
for _choice in _CHOICES:
    _open = [b for k, bits in enumerate(_PART_BITS) if k not in _choice for b in bits]
    _OPEN_BITS.append([_open[k::FINER] for k in range(FINER)])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's UTF-8 bytes."""
    words = data.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 2:
        return digest(text, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    counts = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):
        last = min(n, first + (1 << 16))
        starts = [0, *ends[: last - 1]][first:] if first == 0 else ends[first - 1 : last - 1]
        h = np.array([digest(text[a : b - 1], SEED) for a, b in zip(starts, ends[first + shingle - 1 : last + shingle - 1], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each text, null as the empty one, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances to the pivots of all bits, a row for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ _REFERENCES[None, :]).astype(np.int8)


def _coordinates(fps: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """For each fingerprint and part, its distances to the part's pivots as one number."""
    codes = np.zeros((len(fps), len(parts)), np.uint64)
    for k, bits in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in bits))
        for pivot in (_BASE, *(_BASE ^ 1 << b for b in bits)):
            codes[:, k] = codes[:, k] * np.uint64(16) + np.bitwise_count((fps ^ np.uint64(pivot)) & mask)
    return codes


def _numbers(codes: np.ndarray, choices: list[tuple[int, ...]]) -> np.ndarray:
    """For each fingerprint and choice of parts, a number for its coordinates there (choices apart; that two cells get
    one number costs some comparisons and no link)."""
    cells = np.zeros((len(codes), len(choices)), np.uint64)
    for c, parts in enumerate(choices):
        for part in parts:
            cells[:, c] += codes[:, part] * _FACTORS[c, part]
        cells[:, c] ^= cells[:, c] >> np.uint64(31)
        cells[:, c] *= _FACTORS[c, 0]
    return cells


def cell_numbers(fps: np.ndarray) -> np.ndarray:
    """The cells of each fingerprint, one for each choice of parts."""
    return _numbers(_coordinates(fps, _PART_BITS), _CHOICES)


def wider_numbers(fps: np.ndarray) -> np.ndarray:
    """The cells of each fingerprint for the wider radius, one for each choice of AGREE parts."""
    return _numbers(_coordinates(fps, _PART_BITS), _WIDER)


def finer_numbers(fps: np.ndarray, cell: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The finer cells of each fingerprint of a large cell, made for that choice."""
    out = np.zeros((len(fps), len(_FINER)), np.uint64)
    for c in np.unique(choice).tolist():
        own = choice == c
        out[own] = _numbers(_coordinates(fps[own], _OPEN_BITS[c]), _FINER)
    return (out ^ cell[:, None]) * np.uint64(0x9E3779B97F4A7C15)


def _survive(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose largest coordinate difference is radius at most."""
    for first in range(0, table.shape[1], 4):
        near = (np.abs(table[i, first : first + 4] - table[j, first : first + 4]) <= radius).all(1)
        i, j = i[near], j[near]
    return i, j


def _verified(fps: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, radius: int = MAX_BITS, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    i, j = _survive(table, i, j, radius)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    if second is not None:
        near &= np.bitwise_count(second[i] ^ second[j]) <= SECOND
    return i[near], j[near]


def _reached(fps: np.ndarray, table: np.ndarray, radius: int = MAX_BITS, second: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(a fingerprint's place, the places reached from it first) of one cell, in the order of the search."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table, second = fps[order], table[order], None if second is None else second[order]
    # partners stand within radius of each other's first distance
    begins = np.searchsorted(table[:, 0], table[:, 0] - radius)
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    waiting = np.ones(len(fps), bool)
    for start in range(len(fps)):
        front = [start] if waiting[start] else []
        waiting[start] = False
        while front:
            at = front.pop()
            near = begins[at] + np.flatnonzero(waiting[begins[at] : ends[at]])
            _, found = _verified(fps, np.full(len(near), at), near, table, radius, second)
            if len(found):
                waiting[found] = False
                front.extend(found.tolist())
                yield int(order[at]), order[found]


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without those whose ends earlier ones connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        low, high = sorted((find(a), find(b)))
        if low != high:
            root[high], keep[k] = low, True
    return i[keep], j[keep]


def cell_links(fps: np.ndarray, sizes: np.ndarray, radius: int = MAX_BITS, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """fps: the fingerprints of cells of these sizes, cell after cell. Links (a, b) of fingerprints, just enough to connect
    whatever is within radius in a cell, and within SECOND by the second fingerprints if there are any."""
    base = np.cumsum(sizes) - sizes
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    own = lambda at: None if second is None else second[at]
    for size in np.unique(sizes[sizes <= SMALL]).tolist():
        a, b = np.triu_indices(size, 1)
        at = base[sizes == size]
        step = max(1, (1 << 20) // max(1, len(a)))
        for k in range(0, len(at), step):
            inner = (at[k : k + step, None] + np.arange(size)).ravel()
            first = size * np.arange(len(inner) // size)[:, None]
            i, j = _forest(*_verified(fps[inner], (first + a).ravel(), (first + b).ravel(), pivot_table(fps[inner]), radius, own(inner)))
            pairs.append((inner[i], inner[j]))
    for at, size in zip(base[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        cell = slice(at, at + size)
        pairs += [(np.full(len(found), at + i), at + found) for i, found in _reached(fps[cell], pivot_table(fps[cell]), radius, own(cell))]
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    return fps[i], fps[j]


def _compared(cells: DataFrame, radius: int) -> DataFrame:
    """cells (fps, and second ones if wanted): the links (a, b) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            fps, *second = (lists.values.to_numpy().view(np.uint64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()] for lists in batch.columns)
            a, b = cell_links(fps, np.diff(ends).astype(np.int64), radius, *second)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """distinct (fp): links (a, b) that connect every two fingerprints within MAX_BITS of each other."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            cells = cell_numbers(fps.view(np.uint64)).view(np.int64)
            choice = np.tile(np.arange(len(_CHOICES), dtype=np.int8), len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(choice), pa.array(np.repeat(fps, cells.shape[1]))], ["cell", "choice", "fp"])

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, choice, fps = (batch.column(k).to_numpy() for k in range(3))
            finer = finer_numbers(fps.view(np.uint64), cell.view(np.uint64), choice).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(finer.ravel()), pa.array(np.repeat(fps, finer.shape[1]))], ["cell", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "cell long, choice tinyint, fp long")
    cells = dealt.groupBy("cell", "choice").agg(F.collect_list("fp").alias("fps"))  # 2 ** 22 at most
    cells = cut(cells.filter(F.size("fps") > 1), "cells")
    large = cells.filter(F.size("fps") > LARGE).select("cell", "choice", F.explode("fps").alias("fp"))
    finer = large.mapInArrow(deal_again, "cell long, fp long").groupBy("cell").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    every = cells.filter(F.size("fps") <= LARGE).select("fps").union(finer.select("fps"))
    out = cut(_compared(every, MAX_BITS), "links")
    drop_cut(cells)
    return out


def near_links(distinct: DataFrame) -> DataFrame:
    """distinct (fp, and a second fingerprint if wanted): links (a, b) of fingerprints that differ in RADIUS bits at most and
    agree on AGREE parts, as all do that differ in len(PARTS) - AGREE bits, and most that differ in a few more. Where there
    are second fingerprints these differ in SECOND bits at most.

    A cell gives enough links to connect what these bring together, so no more than it has members. One of over CROWD is
    dealt by hash to parts of about CROWD; each holds the cell's least fingerprint, so what is near to that stays
    connected. Between others of two parts links may be missing: whoever needs all of them searches on."""
    columns = [c for c in ("fp", "second") if c in distinct.columns]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = wider_numbers(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)
            again = [pa.array(np.repeat(c.to_numpy(), cells.shape[1])) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *again], ["cell", *columns])

    dealt = distinct.select(*columns).mapInArrow(deal, "cell long, " + ", ".join(f"{c} long" for c in columns))
    own = F.struct(*columns)
    shared = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min(own).alias("lead")).filter("n > 1")
    held = dealt.join(shared, "cell").groupBy("cell", "lead", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / CROWD)).alias("part"))
    cells = held.agg(F.collect_list(own).alias("all")).select(F.array_union("all", F.array("lead")).alias("all"))
    return cut(_compared(cells.select(*(F.col(f"all.{c}").alias(c) for c in columns)), RADIUS), "near-links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) of every document: component_id is the smallest id among those reachable by links.

    A null text counts as empty, an empty one has fingerprint zero; texts of fewer words than a shingle are one shingle.
    Rows may repeat; null ids are never the smallest, unless a component has no other; an empty table gives an empty one.
    """
    fps = cut(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    edges = links(distinct)
    labels = cut(connected_components(edges), "labels")
    known = cut(labels.join(distinct, labels["node"] == distinct["fp"]).select("fp", "root", "first"), "known")
    least = cut(known.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    linked = cut(known.join(least, "root").select("fp", "component_id"), "linked")
    named = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    drop_cut(distinct, edges, labels, known, least, linked)
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
