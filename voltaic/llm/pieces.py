"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

The symbols of all words of a batch lie in one flat array. In each round every word takes the lowest rank among its
pairs of neighbours and merges that pair wherever it stands, leftmost first; what is merged is compacted away, and words
without a pair left are set aside, until none has one. Symbols that are no pieces become bytes.

Words are cut where no piece can reach across: at blanks (pieces hold them at their beginning only, else texts stay
whole) and between characters that are neighbours in no piece. Merging all places of a pair at once equals merging them
one by one unless a longer piece ranks no lower than its part; such pairs merge only at a word's first place in a round.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: What the library writes for the unknown piece.
UNKNOWN_SURFACE = " ⁇ "
#: Types of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Most words that a worker remembers, and characters merged at a time; results don't depend on them.
_CACHE, _BATCH_CHARS = 300_000, 1 << 20
#: Words of more symbols, once a pair must wait its turn, are finished by a queue instead of round by round.
_LONG = 1000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """A BPE model file: its pieces, the ranks of pairs, and both directions."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        # field numbers of the published format: 1 pieces (1 text, 2 score, 3 type), 2 trainer (3 model type, 35 byte fallback), 3 normalizer
        found = [dict(_fields(v)) for k, v in model if k == 1]
        trainer = dict(_fields(next(v for k, v in model if k == 2)))
        normal = dict(_fields(next((v for k, v in model if k == 3), b"")))
        self.kinds = [p.get(3, NORMAL) for p in found]
        if trainer.get(3, 1) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only BPE with byte fallback, identity normalisation, and neither user-defined nor unused pieces")
        self.prefix = BLANK if normal.get(3, 1) else ""
        self.names = [p[1].decode() for p in found]
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in found]
        self.bytes = [0] * 256
        for i, (name, kind) in enumerate(zip(self.names, self.kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(name[1:-1], 16)] = i
        self._rank(scores)
        self.words: dict[str, tuple[int, ...]] = {}
        # a control piece is no text; by a byte that is never UTF-8 it keeps bytes on its sides apart
        self.surface = [b"\xff" if k == CONTROL else UNKNOWN_SURFACE.encode() if k == UNKNOWN else bytes([self.bytes.index(i)]) if k == BYTE else n.replace(BLANK, " ").encode() for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True))]
        self.is_byte = frozenset(self.bytes)
        self.blank_first = {i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL and n.startswith(BLANK)}

    def _rank(self, scores: list[float]) -> None:
        known = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        # symbols: pieces, then characters that occur in pieces without being one, then all others
        symbols = dict(known)
        for name in known:
            for c in name:
                symbols.setdefault(c, len(self.names) + len(symbols) - len(known))
        self.foreign = len(self.names) + len(symbols) - len(known)
        self.size = self.foreign + 1
        self.of_char = np.full(0x110000, self.foreign, np.int32)
        pairs: dict[int, tuple[int, int]] = {}
        neighbours, unsafe = set(), np.zeros(len(order) + 1, bool)
        for name, i in known.items():
            rank = order[scores[i]]
            if len(name) == 1:
                self.of_char[ord(name)] = i
            for k in range(1, len(name)):
                neighbours.add((name[k - 1], name[k]))
                a, b = symbols.get(name[:k]), symbols.get(name[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank, i)
                    for part in (a, b):
                        if part < len(self.names) and len(self.names[part]) > 1 and order[scores[part]] >= rank:
                            unsafe[order[scores[part]]] = True
        for c, i in symbols.items():
            if i >= len(self.names):
                self.of_char[ord(c)] = i
        self.none, self.unsafe = len(order), unsafe
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.merged = (np.array([pairs[k][j] for k in self.keys.tolist()], np.int64) for j in (0, 1))
        self.touching = np.array(sorted(ord(a) << 21 | ord(b) for a, b in neighbours), np.int64)
        joined = {c for name in known if len(name) > 1 for c in name}
        lone = "".join(c for c in "\n\t\v\f\r\x85 " if c not in joined)
        blank = f"[ {BLANK}]"
        if any(re.search(f"[^{BLANK}]{BLANK}", name) for name in known):
            self.split = re.compile("(?s).+").findall
        else:
            self.split = re.compile(f"{blank}*[^ {BLANK}{re.escape(lone)}]+|[{re.escape(lone)}]+|{blank}+" if lone else f"{blank}*[^ {BLANK}]+|{blank}+").findall

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its rank, `none` if no piece, and that piece."""
        if not len(self.keys):
            return np.full(len(left), self.none), np.zeros(len(left), np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none), self.merged[at]

    def _queue(self, symbols: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
        """One word's merges in their order, one at a time: lowest rank first, then leftmost. What is left, and the characters of each."""
        at = {k: j for j, k in enumerate(self.keys.tolist())} if not hasattr(self, "_at") else self._at
        self._at = at
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := at.get(symbols[i] * self.size + symbols[j])) is not None:
                heapq.heappush(waiting, (int(self.rank[found]), i, lengths[i], lengths[j], int(self.merged[found])))

        for i in range(n - 1):
            offer(i, i + 1)
        while waiting:
            _, i, own, other, piece = heapq.heappop(waiting)
            j = after[i]
            if lengths[i] != own or j >= n or lengths[j] != other:
                continue  # either side has grown since, or is gone
            symbols[i], lengths[i] = piece, own + other
            lengths[j], after[i] = 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        left = [i for i in range(n) if lengths[i]]
        return [symbols[i] for i in left], [lengths[i] for i in left]

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        sizes = np.array(list(map(len, words)), np.int64)
        codes = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbol, length = self.of_char[codes].astype(np.int64), np.ones(len(codes), np.int64)
        first = np.arange(len(codes))  # of each symbol, its first character
        edge = np.zeros(len(codes), bool)
        edge[np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0]] = True
        if len(codes) > 1:
            key = codes[:-1] << 21 | codes[1:]
            at = np.minimum(np.searchsorted(self.touching, key), max(0, len(self.touching) - 1))
            edge[1:] |= self.touching[at] != key if len(self.touching) else True
        owner = np.cumsum(edge)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = np.full(len(symbol), self.none), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(~edge[1:]) if len(edge) else np.zeros(0, np.int64)
        rank[inner], piece[inner] = self.pair(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            held = np.diff(np.append(starts, len(symbol)))
            over = lowest == self.none
            several = self.unsafe[lowest] & (held > _LONG) & ~over
            for k in np.flatnonzero(several).tolist():
                part = slice(starts[k], starts[k] + held[k])
                if (rank[part] == lowest[k]).sum() > 1:
                    ids, grown = self._queue(symbol[part].tolist(), length[part].tolist())
                    grown = np.array(grown, np.int64)
                    done.append((first[part][0] + np.cumsum(grown) - grown, np.array(ids, np.int64), grown))
                else:
                    several[k] = False
            if over.any():
                gone = np.repeat(over, held)
                done.append((first[gone], symbol[gone], length[gone]))
            if over.any() or several.any():
                stay = ~np.repeat(over | several, held)
                symbol, length, first, owner, rank, piece = (x[stay] for x in (symbol, length, first, owner, rank, piece))
                held, lowest = held[~(over | several)], lowest[~(over | several)]
                if not len(symbol):
                    break
            hit = rank == np.repeat(lowest, held)
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) > 1]  # where hits overlap every other one merges
            at = at[((np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) & 1) == 0]
            wait = self.unsafe[rank[at]] & np.r_[False, owner[at[1:]] == owner[at[:-1]]]
            at = at[~wait]
            symbol[at] = piece[at]
            length[at] += length[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(symbol), bool)
            fresh[at] = True
            symbol, length, first, owner, rank, piece, fresh = (x[keep] for x in (symbol, length, first, owner, rank, piece, fresh))
            i = np.flatnonzero(fresh | np.r_[fresh[1:], False])  # only pairs beside what has merged are new
            j = np.minimum(i + 1, len(symbol) - 1)
            inside = (owner[i] == owner[j]) & (j > i)
            rank[i] = self.none
            rank[i[inside]], piece[i[inside]] = self.pair(symbol[i[inside]], symbol[j[inside]])
        starts, ids, length = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(starts)
        starts, ids, length = starts[order], ids[order], length[order]
        bounds = np.searchsorted(starts, np.cumsum(np.r_[0, sizes])).tolist()
        odd = np.flatnonzero(ids >= len(self.names)).tolist()
        numbers: list = ids.tolist()
        for k in odd:  # single characters: whatever has merged is a piece
            numbers[k] = [self.bytes[b] for b in chr(codes[starts[k]]).encode("utf-8", "replace")]
        out, strange = [], set(odd)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = numbers[a:b]
            if strange and not strange.isdisjoint(range(a, b)):
                part = list(chain.from_iterable(x if isinstance(x, list) else (x,) for x in part))
            out.append(tuple(part))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; words already met are looked up."""
        cut = [self.split(self.prefix + t) if t else [] for t in texts]
        new = [w for w in set().union(*cut) if w not in self.words]
        self.words.update(zip(new, self.merge(new), strict=True))
        out = [list(chain.from_iterable(map(self.words.__getitem__, c))) for c in cut]
        full = len(self.words) > _CACHE  # then what came before stays known
        for w in new:
            if full or len(w) > 64:
                del self.words[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with blanks, without the blank put before a text; runs of bytes as UTF-8, one sign for
        each byte that is none."""
        out, k, n = [], 0, len(ids)
        while k < n and self.kinds[ids[k]] == CONTROL:
            k += 1
        if k < n and self.prefix and ids[k] in self.blank_first:
            out.append(self.surface[ids[k]][1:])
            k += 1
        out += map(self.surface.__getitem__, ids[k:])
        try:
            return b"".join(out).decode()
        except UnicodeDecodeError:  # bytes join to characters only among themselves, never with a piece
            parts: list[str] = []
            run: list[bytes] = []
            for i, s in chain(zip(ids[len(ids) - len(out) :], out, strict=True), ((-1, b""),)):
                if i in self.is_byte:
                    run.append(s)
                    continue
                parts.append(_lenient(b"".join(run)))
                run = []
                parts.append(s.decode() if s != b"\xff" else "")
            return "".join(parts)


def _lenient(data: bytes) -> str:
    """UTF-8, with a replacement character for each byte that begins no character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_models: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One model a Python worker: the words it has met serve its next tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _groups(texts: list, size) -> Iterator[list[int]]:
    """Places of a batch, so many at a time that their sizes stay near _BATCH_CHARS."""
    group, total = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        total += size(t)
        if total > _BATCH_CHARS:
            yield group
            group, total = [], 0
    if group:
        yield group


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of every whole text, and with decoded what those ids decode to: no begin or end ids, no sampling.

    model: path of a SentencePiece BPE model with byte fallback, on every executor. A null text counts as the empty one
    (no ids); ids may be null or repeat, each row gives one row; other columns are not read; an empty table gives an
    empty one. A very long text costs memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for group in _groups(texts, len):
                found = own.encode([texts[i] for i in group])
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                columns = [batch.column(0).slice(group[0], len(group)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array(list(map(own.decode, found)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + (", decoded string" if decoded else "")
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids. A null list, and null ids in one, count for nothing; ids outside the model are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for batch in batches:
            lists = [[i for i in x or () if i is not None] for x in batch.column(1).to_pylist()]
            if any(i < 0 or i >= len(own.names) for x in lists for i in x):
                raise ValueError(f"ids lie between 0 and {len(own.names) - 1}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(own.decode, lists)), pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
