"""Toxicity by maximum-scoring segments.

A token's score is its log-odds between toxic and clean training texts, by counts of tokens (MOST_A_TEXT a text at most, so that no text decides
alone) under a Dirichlet prior: the prior of a token is the split of its beginning, that of a beginning the next shorter
one's, and at last that of all tokens. Only a split that differs from its prior's for sure is kept; a word takes that of
itself or else of its longest kept beginning. Less a drift, clean text scores below zero. One scan finds every maximal
scoring segment of a text. The chance that clean text of that length holds a segment as good follows an extreme-value
law; a text's evidence is the sum over its segments of what they exceed that law by, and a logistic curve turns evidence
into a score. Law and curve are fitted on training texts that the scores they see were not learnt from (FOLDS folds).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaic.llm._common import sliced

#: Scores of words that a model keeps at most, and those of one text besides.
_CACHE = 100_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¡¿"


def token(word: str) -> str:
    """A word in lower case without the signs around it."""
    return word.lower().strip(_EDGES)


#: Lengths of a token's beginnings that stand for tokens seen too seldom; such an entry is written with a star.
BEGINNINGS = (6, 5, 4, 3)
#: A token counts so often in one text at most.
MOST_A_TEXT = 10
FOLDS = 4
LAW_AT = 0.98


def chain(name: str) -> list[str]:
    """The token and its beginnings, from the longest to the shortest; each is the child of the next."""
    return [name, *(name[:n] + "*" for n in BEGINNINGS if len(name) >= n)]


@dataclass
class Model:
    scores: dict[str, float]  #: of tokens and their beginnings; others score -drift
    drift: float
    scale: float = 1.0  #: lambda of the extreme-value law
    shift: float = 0.0  #: ln K of it
    slope: float = 0.0
    offset: float = -40.0
    known: dict[str, float] = field(default_factory=dict)

    def name_score(self, name: str) -> float:
        return next((self.scores[x] for x in chain(name) if x in self.scores), -self.drift)

    def word_scores(self, words: list[str]) -> np.ndarray:
        try:
            return np.array(list(map(self.known.__getitem__, words)))
        except KeyError:
            pass
        if len(self.known) > _CACHE:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.name_score(token(w))
        out = np.array(list(map(self.known.__getitem__, words)))
        for w in [w for w in set(words) if len(w) > 256]:
            del self.known[w]
        return out

    def passages(self, text: str) -> list[tuple[int, int, float, float]]:
        """(first word, last word, score, excess) of each significant passage."""
        scores = self.word_scores(text.split())
        law = self.shift + math.log(max(1, len(scores)))
        return [(a, b, s, self.scale * s - law) for a, b, s in maximal_segments(scores) if self.scale * s > law]

    def evidence(self, text: str) -> float:
        return sum(p[3] for p in self.passages(text))

    def chance(self, evidence: float) -> float:
        x = self.slope * math.log1p(evidence) + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))

    def score(self, text: str) -> float:
        return self.chance(self.evidence(text))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), left to right, in linear time.

    Words of one sign in a row are one item; each item is appended to the list of candidates, which a candidate leaves
    only by being joined into a longer one.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, positive, False].astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # first, last, sum before, sum up to the end, index of the last candidate to the left that starts lower
    kept: list[tuple[int, int, float, float, int]] = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        low, high = float(sums[a]), float(sums[b])
        first = a
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, b - 1, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _labelled(df: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of a sample of about most labelled rows, by the id's hash; the sampled labels are broadcast."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "id").select("text", "label")


def _tallies(sample: DataFrame) -> DataFrame:
    """(token, parent, y0, y1 and, of those, y0_k and y1_k in fold k) of tokens and beginnings, and of "" for all tokens."""
    each = [f"y{label}_{k}" for k in range(FOLDS) for label in (0, 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            parents: dict[str, str] = {"": ""}
            for text, label in ((t, y) for part in sliced(iter([batch])) for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                column = (label == 1) + 2 * fold(text)
                names: dict[str, int] = {}
                for word, times in Counter(text.split()).items():
                    name = token(word)
                    names[name] = names.get(name, 0) + times
                names.pop("", None)
                counts = {"": sum(min(n, MOST_A_TEXT) for n in names.values())}
                for name, times in names.items():
                    line = chain(name)
                    parents.update(zip(line, [*line[1:], ""], strict=True))
                    for x in line:
                        counts[x] = counts.get(x, 0) + times
                for x, times in counts.items():
                    tally.setdefault(x, [0] * len(each))[column] += times if x == "" else min(times, MOST_A_TEXT)
            numbers = np.array(list(tally.values()), np.int64).reshape(-1, len(each))
            columns = [pa.array(list(tally), pa.string()), pa.array([parents[x] for x in tally], pa.string()), *(pa.array(numbers[:, k]) for k in range(len(each)))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "parent", *each])

    counted = sample.mapInArrow(count, "token string, parent string, " + ", ".join(f"{c} long" for c in each))
    summed = counted.groupBy("token").agg(F.min("parent").alias("parent"), *(F.sum(c).alias(c) for c in each))
    return summed.withColumns({f"y{label}": sum((F.col(c) for c in each[label::2][1:]), F.col(each[label])) for label in (0, 1)})


def fold(text: str) -> int:
    return zlib.crc32(text.encode()) % FOLDS


def _log_odds(y0: Column, y1: Column, p0: Column, p1: Column, share: float, prior: float, least_count: int, least_z: float) -> Column:
    """Log-odds of a token counted y0, y1 times whose parent was counted p0, p1 times; null unless they surely differ."""
    n, expected = y0 + y1, (p1 + prior * share) / (p0 + p1 + prior)
    part = lambda y, e: F.when(y > 0, y * F.log(y / (n * e))).otherwise(0.0)
    ratio = 2 * (part(y1, expected) + part(y0, 1 - expected))
    q = (y1 + prior * expected) / (n + prior)
    return F.when((n >= least_count) & (ratio >= least_z**2), F.log(q / (1 - q)) - math.log(share / (1 - share)))


def _scale(values: np.ndarray, mass: np.ndarray) -> float:
    """The positive solution of E exp(scale * score) = 1 for the scores of clean words; 64 at most."""

    def total(scale: float) -> float:
        return float((mass * np.exp(np.minimum(scale * values, 600))).sum() - mass.sum())

    low, high = 1e-3, 1.0
    while total(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 0 else (low, middle)
    return high


def fit(
    df: DataFrame, labels: DataFrame, most_rows: int = 40_000, prior: float = 2.0, drift: float = 0.5, least_count: int = 3, least_z: float = 3.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Learn from labels (id, label 0 or 1). most_rows: about so many labelled rows are used, chosen by hash of the id.
    prior: how many tokens the prior weighs as; least_z: how sure (as a normal deviate) a split must differ from its
    prior's to be kept. Without rows of both labels every text scores 0 (no token then has a score).

    What comes to the driver is bounded by most_rows: the kept splits and each sampled text's segment scores.
    """
    sample = _labelled(df, labels, most_rows, id_col, text_col, label_col).distinct().persist()
    tallies = _tallies(sample).filter(F.col("y0") + F.col("y1") >= least_count).persist()
    all_tokens = tallies.filter(F.col("token") == "").first()
    if all_tokens is None or not all_tokens["y0"] or not all_tokens["y1"]:
        return Model({}, drift)
    # the counts that each model does without: none, then those of a fold
    parts = [(None, None), *((f"y0_{k}", f"y1_{k}") for k in range(FOLDS))]
    left = [tuple(all_tokens[y] - (all_tokens[less] if less else 0) for y, less in zip(("y0", "y1"), part, strict=True)) for part in parts]
    if not all(min(pair) > 0 for pair in left):  # without some fold a label is missing: no folds
        parts, left = parts[:1], left[:1]
    names = [c for c in tallies.columns if c.startswith("y")]
    parents = tallies.select(F.col("token").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in names))
    both = tallies.filter(F.col("token") != "").join(parents, "parent")
    counts = lambda of, part: [F.col(of + y) - (F.col(of + less) if less else F.lit(0)) for y, less in zip(("y0", "y1"), part, strict=True)]
    odds = [
        _log_odds(*counts("", part), *counts("p_", part), n1 / (n0 + n1), prior, least_count, least_z).alias(f"d{k}")
        for k, (part, (n0, n1)) in enumerate(zip(parts, left, strict=True))
    ]
    rows = both.select("token", *odds).filter(F.coalesce(*(f"d{k}" for k in range(len(parts)))).isNotNull()).collect()
    models = [Model({r["token"]: r[f"d{k}"] - drift for r in rows if r[f"d{k}"] is not None}, drift) for k in range(len(parts))]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1)
            for k, model in enumerate(models):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(names), pa.int32()), pa.array([model.name_score(x) for x in names], pa.float64()), n], ["k", "score", "n"])

    whole = tallies.filter(~F.col("token").endswith("*") & (F.col("token") != "")).select("token", "y0")
    masses = whole.mapInArrow(weigh, "k int, score double, n long").groupBy("k", "score").agg(F.sum("n").alias("n")).toPandas()
    rest = all_tokens["y0"] - masses[masses["k"] == 0]["n"].sum()  # tokens too rare to be counted score as unknown ones
    for k, model in enumerate(models):
        own = masses[masses["k"] == k]
        model.scale = _scale(np.r_[own["score"], -drift], np.r_[own["n"], rest])
    folded = len(models) > 1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            folds, sizes, rows = [], [], []
            for text in batch.column(0).to_pylist():
                folds.append(k := 1 + fold(text) if folded else 0)  # the model that has not seen it
                words = text.split()
                sizes.append(len(words))
                rows.append([x for _, _, x in maximal_segments(models[k].word_scores(words))])
            columns = [batch.column(1), pa.array(folds, pa.int32()), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "k", "n", "s"])

    fitted = sample.mapInArrow(best, "label int, k int, n long, s array<double>").toArrow()
    sample.unpersist()
    tallies.unpersist()
    labels_seen, by, sizes = (fitted[c].to_numpy() for c in ("label", "k", "n"))
    scores = [np.asarray(s.values) for s in fitted["s"]]
    scales = np.array([m.scale for m in models])[by]
    clean = labels_seen != 1
    top = scales * np.array([max(s, default=0.0) for s in scores]) - np.log(np.maximum(1, sizes))
    model = models[0]
    # K from the tail: a share 1 - LAW_AT of the clean texts lies over the law's value for it
    model.shift = float(np.quantile(top[clean], LAW_AT)) + math.log(-math.log(LAW_AT))
    law = model.shift + np.log(np.maximum(1, sizes))
    x = np.log1p([np.maximum(0, scale * s - limit).sum() for s, scale, limit in zip(scores, scales, law, strict=True)])
    model.slope, model.offset = _logistic(x, (~clean).astype(float))
    model.known = {}
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> tuple[float, float]:
    """Slope and offset of a logistic curve: Newton steps, halved until the penalised loss falls."""

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float((np.logaddexp(0, z) - y * z).sum() + penalty / 2 * (v @ v))

    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -40, 40)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum(), (p - y).sum()]) + penalty * v
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + penalty * np.eye(2)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(step).max() < 1e-9 or size <= 1e-6:
            break
    return float(v[0]), float(v[1])


def score(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """df with tox_score, tox_predicted (1 from threshold on) and tox_passages of every whole text.

    Passages: first and last word, score and excess of each. Null and empty texts hold no passage and get the score of
    that. Every column of df is kept, those of the three names replaced; rows stay as they are, repeated ones too; an
    empty table gives an empty one.
    """
    df = df.drop("tox_score", "tox_predicted", "tox_passages")
    place = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores, spans = [], []
            for text in batch.column(place).to_pylist():
                found = model.passages(text or "")
                scores.append(model.chance(sum(p[3] for p in found)))
                spans.append([dict(zip(("first", "last", "score", "excess"), p, strict=True)) for p in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*batch.schema.names, "tox_score", "tox_passages"])

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL("tox_score double, tox_passages array<struct<first: long, last: long, score: double, excess: double>>").fields])
    return df.mapInArrow(run, schema).withColumn("tox_predicted", (F.col("tox_score") >= threshold).cast("int"))
