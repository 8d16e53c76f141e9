"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, the first rotated
twice and the second once; a text is the sum of its trigrams; a language's prototype is the sum over its texts, each
text weighted to one length. A text's language is the prototype with the largest cosine, after the mean prototype is
taken away from each. The sums over the training texts are whole numbers, so reruns agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
_BATCH_CHARS = 200_000
#: Numbers in a table of weights at most, and trigrams whose vectors are made at a time.
_CELLS, _SEGMENT = 1 << 22, 4096
#: A training text's trigrams weigh this together, in whole numbers.
_WEIGHT = 1 << 20
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 if it is no letter."""
    if "letters" not in _tables:
        out = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                out[c] = ord(x.lower()[0])
        _tables["letters"] = out
    return _tables["letters"]


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """(n, dimensions) of +1 and -1: the same vector for the same code point, always."""
    return np.stack([np.random.default_rng([7, int(c)]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1 for c in codes]) if len(codes) else np.zeros((0, dimensions), np.int8)


class Trigrams:
    """Trigrams of some texts: for each text and trigram, how often; white space and signs are one blank."""

    def __init__(self, texts: list[str], vectors: dict[int, np.ndarray], dimensions: int):
        # a text begins and ends with a blank
        raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *(len(t) + 2 for t in texts)])
        symbol = _letters()[raw]
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        keep = (symbol > 0) | np.r_[True, (symbol[:-1] > 0) | (text[1:] != text[:-1])]
        symbol, text = symbol[keep], text[keep]
        present = np.zeros(0x110000, bool)
        present[symbol] = True
        codes = np.flatnonzero(present)
        place = np.zeros(0x110000, np.int64)
        place[codes] = np.arange(len(codes))
        for c in codes.tolist():
            if c not in vectors:
                vectors[c] = letter_vectors(np.array([c]), dimensions)[0]
        self.items = np.stack([vectors[c] for c in codes.tolist()])
        s, m = place[symbol], len(codes)
        whole = (text[2:] == text[:-2]) & (symbol[1:-1] > 0) if len(s) > 2 else np.zeros(0, bool)
        key = ((text[2:] * m + s[:-2]) * m + s[1:-1]) * m + s[2:] if len(s) > 2 else np.zeros(0, np.int64)
        key = np.sort(key[whole])
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(begin, len(key)))
        self.text, gram = np.divmod(key[begin], m**3)
        self.grams, self.gram = np.unique(gram, return_inverse=True)
        self.base, self.texts = m, len(texts)

    def vectors(self, first: int, last: int) -> np.ndarray:
        """The vectors of trigrams first to last - 1."""
        grams = self.grams[first:last]
        a, b, c = grams // self.base**2, grams // self.base % self.base, grams % self.base
        return np.roll(self.items, 2, axis=1)[a] * np.roll(self.items, 1, axis=1)[b] * self.items[c]

    def bundles(self, weights: np.ndarray, dtype=np.float32, owner: np.ndarray | None = None, owners: int = 0) -> np.ndarray:
        """(owners, dimensions): the weighted sums of each owner's trigram vectors; owner: of each entry, its text by default.

        The trigrams are taken segment by segment, and owners so many at a time, so that neither a long text of many
        different letters nor many short texts make a large table.
        """
        owner, owners = (self.text, self.texts) if owner is None else (owner, owners)
        out = np.zeros((owners, self.items.shape[1]), dtype)
        order = np.argsort(self.gram, kind="stable")
        gram, owner, weights = self.gram[order], owner[order], weights[order]
        for first in range(0, len(self.grams), _SEGMENT):
            vectors = self.vectors(first, first + _SEGMENT).astype(dtype)
            a, b = np.searchsorted(gram, (first, first + _SEGMENT))
            own = owner[a:b]
            step = max(1, _CELLS // len(vectors))
            for low in range(0, owners, step):
                here = (own >= low) & (own < low + step)
                if here.any():
                    table = np.zeros((min(step, owners - low), len(vectors)), dtype)
                    np.add.at(table, (own[here] - low, gram[a:b][here] - first), weights[a:b][here])
                    out[low : low + step] += table @ vectors
        return out


def _parts(texts: list[str]) -> Iterator[range]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > _BATCH_CHARS:
            yield range(first, i)
            first, size = i, 0
        size += len(t)
    if texts:
        yield range(first, len(texts))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes. All rows with a language and a text with letters are used.

    Each task sends one vector a language; these are summed by dimension. The driver gets languages x dimensions numbers.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(texts):
                grams = Trigrams([texts[i] for i in part], known, dimensions)
                length = np.bincount(grams.text, grams.count, grams.texts)
                weights = grams.count * _WEIGHT // np.maximum(length, 1).astype(np.int64)[grams.text]
                names = sorted({langs[i] for i in part})
                by_lang = np.searchsorted(names, [langs[i] for i in part])
                for name, vector in zip(names, grams.bundles(weights, np.float64, by_lang[grams.text], len(names)), strict=True):
                    total[name] = total.get(name, 0) + vector.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(sums, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    table = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    langs = sorted(table["lang"].unique())
    out = np.zeros((len(langs), dimensions))
    if langs:
        out[np.searchsorted(langs, table["lang"]), table["i"]] = table["x"].astype(float)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.where(norm > 0, norm, 1)
    if len(langs) > 1:
        out = out - out.mean(0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each whole text. score: half of one plus the cosine.

    A null text, one without letters, and any text where nothing was learned, is "und" with score 0; ties go to the
    first language in order; ids may be null or repeat; an empty table gives an empty one.
    """
    langs, prototypes = model
    dimensions = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, score = ["und"] * len(texts), np.zeros(len(texts))
            for part in _parts(texts) if langs else ():
                grams = Trigrams([texts[i] for i in part], known, dimensions)
                bundle = grams.bundles(grams.count)
                norm = np.linalg.norm(bundle, axis=1)
                cosine = bundle @ prototypes.T / np.where(norm > 0, norm, 1)[:, None]
                best = cosine.argmax(1)
                for i in np.unique(grams.text).tolist():
                    found[part[i]] = langs[best[i]]
                    score[part[i]] = min(1.0, max(0.0, (1 + float(cosine[i, best[i]])) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
