"""Token counts of byte-level BPE by rank-synchronous merging in numpy arrays.

All pre-tokens of a batch lie in one ragged array of symbols. In each round every sequence that can still merge
takes its own lowest-ranked pair and merges all of its occurrences, leftmost first; what is left in the end are the
tokens. Only pre-tokens not seen before in the task are merged; the memory of counts is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words, and most pre-tokens, whose counts a worker remembers; results don't depend on it.
_CACHE = 700_000


def _byte_symbols() -> list[str]:
    """The printable character by which the vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = dict(zip(plain, map(chr, plain), strict=True))
    for byte in range(256):
        if byte not in names:
            names[byte] = chr(256 + len(names) - len(plain))
    return [names[b] for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs, and the merging of ragged arrays of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        names = _byte_symbols()
        self.first = np.array([vocab[c] for c in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; len(keys) where it is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all pieces one after the other, and their number in each piece."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # piece of each symbol, symbol
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        none = len(self.keys)
        rank = None
        while len(symbols):
            together = owner[1:] == owner[:-1]
            if rank is None:
                rank = np.full(len(symbols), none)
                rank[:-1][together] = self.ranks(symbols[:-1][together], symbols[1:][together])
            starts = np.flatnonzero(np.r_[True, ~together])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = lowest == none
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((owner[gone], symbols[gone]))
                keep = ~gone
                symbols, owner, rank, sizes, lowest = symbols[keep], owner[keep], rank[keep], sizes[~over], lowest[~over]
                if not len(symbols):
                    break
            hit = (rank < none) & (rank == np.repeat(lowest, sizes))
            if (hit[1:] & hit[:-1]).any():  # a a a: only every other place of a chain of hits merges
                at = np.flatnonzero(hit)
                chain = np.r_[True, np.diff(at) > 1]
                odd = (np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))) & 1
                hit[at[odd == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # only pairs beside a merged symbol have a new rank
            fresh = hit[keep] | np.r_[hit[keep][1:], False]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            i = np.flatnonzero(fresh)
            nxt = np.minimum(i + 1, len(symbols) - 1)
            pair = (owner[nxt] == owner[i]) & (nxt > i)
            rank[i] = none
            rank[i[pair]] = self.ranks(symbols[i[pair]], symbols[nxt[pair]])
        owners = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        values = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        return values[order], np.bincount(owners, minlength=len(pieces))


#: What is tried on either side of a cut: letters, cases, marks, digits, signs, scripts, contractions.
_LEFT = ("a", "Ab", "é", "1", "12", ".", "'", "'s", "-", "_", "中", "\u0301", "?!", "a's", "x1")
_RIGHT = tuple(blank + right for blank in " \n" for right in (*_LEFT, "'ll b", "b\nc", "b c"))


class TokenCounter:
    """Counts of whole texts; special tokens of the vocabulary are recognised in texts, each one token."""

    def __init__(self, path: str, pattern: str):
        self.table = MergeTable(path)
        self.split = regex.compile(pattern).findall
        # words are looked up one by one only if the pattern never joins text across a lone blank's left end
        self.by_word = all(self.split(a + b) == self.split(a) + self.split(b) for a in _LEFT for b in _RIGHT)
        self.special = regex.compile("|".join(map(regex.escape, self.table.special))) if self.table.special else None
        self.pretokens: dict[str, int] = {}
        self.words: dict[str, int] = {}  # what follows a lone space, or a lone line feed and that

    def _tokens(self, pieces: list[list[str]]) -> list[int]:
        """The number of tokens of each list of pre-tokens."""
        if len(self.pretokens) > _CACHE:
            self.pretokens.clear()
        new = [t for t in {t for p in pieces for t in p} if t not in self.pretokens]
        _, counts = self.table.merge([t.encode() for t in new])
        self.pretokens.update(zip(new, counts.tolist(), strict=True))
        known = self.pretokens.__getitem__
        out = [sum(map(known, p)) for p in pieces]
        for t in new:
            if len(t) > 256:
                del self.pretokens[t]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """With most patterns no pre-token lies across the left end of a lone space or line feed between two other
        characters (probed when the counter is made), so a text in which white space is such is cut there and its words
        are looked up; others, and all with other patterns, are split whole."""
        out = [0] * len(texts)
        regular: list[tuple[int, list[str]]] = []
        whole: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            segments = [text]
            if self.special and any(s in text for s in self.table.special):
                segments = self.special.split(text)
                out[i] += len(segments) - 1
            for segment in segments:
                parts = segment.replace("\n", " \n").split(" ")
                if not self.by_word or "" in parts or "\n" in parts or len(segment.split()) != len(parts):
                    whole.append((i, segment))
                else:
                    whole.append((i, parts[0]))
                    regular.append((i, parts[1:]))
        new = [w for w in set().union(*(p for _, p in regular)) if w not in self.words]
        fresh = dict(zip(new, self._tokens([self.split(w if w[0] == "\n" else " " + w) for w in new]), strict=True))
        self.words.update(fresh)
        for i, parts in regular:
            out[i] += sum(map(self.words.__getitem__, parts))
        full = len(self.words) > _CACHE  # then what came before stays known
        for w in new:
            if full or len(w) > 256:
                del self.words[w]
        for (i, _), n in zip(whole, self._tokens([self.split(s) for _, s in whole]), strict=True):
            out[i] += n
        return out


_counters: dict[tuple[str, str], TokenCounter] = {}


def counter_of(path: str, pattern: str) -> TokenCounter:
    """One counter a Python worker: what it has learned serves its next tasks."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = TokenCounter(path, pattern)
    return _counters[path, pattern]


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    vocabulary: path of a byte-level BPE in the tokenizers library's JSON form, on every executor. pattern: how
    texts split before the merges. A null text counts as the empty one (0 tokens); ids may be null or repeat, each
    input row gives one row; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens: list[int] = []
            group: list[str] = []
            size = 0
            for text in texts:
                group.append(text or "")
                size += len(group[-1])
                if size > 1 << 20:
                    tokens += counter.counts(group)
                    group, size = [], 0
            tokens += counter.counts(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    plain = df.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = plain.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
