"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text, and one threshold between each two grades, in order: the chance
of a grade over k is the logistic of weights times features less threshold k. Features are words and word shapes
(letters as a, digits as 0, signs as they are), by hash, with damped counts and unit length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHE = 400_000
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


class Features:
    """Hashed features of whole texts."""

    def __init__(self, bits: int):
        self.size, self.known = 1 << bits, {}

    def _of(self, word: str) -> tuple[int, int]:
        shape = _DIGITS.sub("0", _LETTERS.sub("a", word))[:32]
        return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % self.size, zlib.crc32(b"shape:" + shape.encode("utf-8", "surrogatepass")) % self.size

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if len(self.known) > _CACHE:
            self.known.clear()
        for w in [w for w in set(words) if w not in self.known]:
            self.known[w] = self._of(w)
        both = np.array(list(map(self.known.__getitem__, words)), np.int64).reshape(-1)
        if any(len(w) > 256 for w in words):
            self.known.clear()
        at = np.sort(both)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        values = np.log1p(np.diff(np.append(begin, len(at))))
        norm = np.sqrt((values**2).sum())
        return at[begin], values / norm if norm else values


@dataclass
class Model:
    bits: int
    weights: np.ndarray
    thresholds: np.ndarray  #: ascending; thresholds[k] lies between grades k and k + 1
    features: Features = field(default=None, repr=False)  # type: ignore[assignment]

    def tails(self, text: str) -> np.ndarray:
        """The chance of a grade over 0, over 1, and so on."""
        if self.features is None:
            self.features = Features(self.bits)
        at, values = self.features(text)
        return 1 / (1 + np.exp(self.thresholds - float(self.weights[at] @ values)))


def _fit(at: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, levels: int, size: int, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch Adam on the cumulative-link likelihood; thresholds are a first one and positive steps."""
    flat, value = np.concatenate(at), np.concatenate(values)
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    n = len(at)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels)[:-1]) / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    start = np.maximum.accumulate(start + np.arange(levels - 1) * 1e-3)
    theta = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        steps = np.exp(theta[size + 1 :])
        cuts = np.concatenate([[-np.inf], theta[size] + np.concatenate([[0.0], np.cumsum(steps)]), [np.inf]])
        margin = np.bincount(row, theta[flat] * value, n)
        upper, lower = (1 / (1 + np.exp(np.clip(margin - cuts[grades + k], -40, 40))) for k in (1, 0))
        likely = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        g_margin = (du - dl) / n
        g = np.zeros_like(theta)
        g[:size] = np.bincount(flat, g_margin[row] * value, size) + penalty * theta[:size]
        g_cut = np.zeros(levels + 1)
        np.add.at(g_cut, grades + 1, -du / n)
        np.add.at(g_cut, grades, dl / n)
        inner = g_cut[1:-1]
        g[size] = inner.sum()
        g[size + 1 :] = (np.cumsum(inner[::-1])[::-1][1:]) * steps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:size], theta[size] + np.concatenate([[0.0], np.cumsum(np.exp(theta[size + 1 :]))])


def fit(df: DataFrame, ratings: DataFrame, levels: int, most_rows: int = 20_000, bits: int = 14, penalty: float = 1e-6, rounds: int = 150, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Learn from ratings (id, grade from 0 to levels - 1); others and nulls are left out. most_rows: about so many rated
    rows are used, chosen by hash of the id. Features are made in the tasks; the driver fits on the bounded sample.
    Without ratings every grade is as likely as the next."""
    known = ratings.filter(F.col(grade_col).between(0, levels - 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).distinct()
    n = known.count()
    if n > most_rows:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most_rows / n))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            got = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))], ["grade", "at", "value"])

    got = rows.select("grade", "text").mapInArrow(extract, "grade int, at array<int>, value array<float>").toArrow()
    if not len(got):
        return Model(bits, np.zeros(1 << bits), np.log(np.arange(1, levels) / (levels - np.arange(1, levels))))
    at, values = got["at"].combine_chunks(), got["value"].combine_chunks()
    edges = at.offsets.to_numpy()[1:-1] - at.offsets.to_numpy()[0]
    weights, thresholds = _fit(np.split(at.flatten().to_numpy(), edges), np.split(values.flatten().to_numpy().astype(float), edges), got["grade"].to_numpy().astype(np.int64), levels, 1 << bits, penalty, rounds)
    return Model(bits, weights, thresholds)


def rate(df: DataFrame, model: Model, good: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, p_good, grade_pred, selected) of every whole text.

    p_good: the chance of grade good or better; selected: at least one half. Null and empty texts have no features and
    are rated by the thresholds alone; each input row gives one row; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = np.array([model.tails(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, len(model.thresholds))
            chances = -np.diff(np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, good - 1]), pa.array(chances.argmax(1).astype(np.int32))], ["id", "expected_grade", "p_good", "grade_pred"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, expected_grade double, p_good double, grade_pred int")
    return out.withColumn("selected", F.col("p_good") >= 0.5).withColumnRenamed("id", id_col)
