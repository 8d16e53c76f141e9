"""Substring dedup: words covered by a passage of WINDOW words that occurs elsewhere too.

Every window of WINDOW words contains PHRASE-word phrases, and the one with the least hash represents it, so equal
windows have equal representatives. Representatives that recur in the corpus are the phrases to look for: the words of
each are taken once, from one block of texts that holds it, and sent to every block that may. There a block's phrases are compiled into
an Aho-Corasick automaton (a shard: no block needs another's phrases) through which its whole texts stream. Only where
the automaton locates a phrase are windows considered: those that it represents are counted over the corpus by a
128-bit key, and those that occur twice are confirmed; the words they cover go.

Equal texts are one text with a count: copies are combined before any shuffle, and a text that has a copy is all
repeated. Texts are known by a 128-bit key. They are dealt once to blocks of bounded bytes, in a bucketed table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm._common import bucketed, cut, drop_cut, shuffle_partitions

WINDOW, PHRASE = 35, 18
#: Bytes of text in a block, about.
BLOCK_BYTES = 1 << 19
_BATCH_BYTES = 1 << 19

_ODD1, _ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses
_BYTE = np.random.default_rng(35).integers(0, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts, one text after the other: their places, hashes, phrases and windows."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, phrase: int = PHRASE):
        self.window, self.phrase = window, phrase
        self.buffer = b" ".join(texts) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        word = ~_BLANK[raw]
        self.starts = np.flatnonzero(word & np.r_[True, ~word[:-1]])
        self.ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, offsets)  # word index at which each text begins; one more at the end
        n = len(self.starts)
        ends = np.repeat(self.first[1:], np.diff(self.first))  # of each word's text
        place = np.arange(n)
        self.valid = place + window <= ends
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(_ODD1, len(raw)), dtype=np.uint64)])
        inverse = _powers(pow(_ODD1, -1, 1 << 64), len(raw))
        hashes = _mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_ODD2, n), dtype=np.uint64)])
        self.inverse = _powers(pow(_ODD2, -1, 1 << 64), n)
        self.phrases = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        if n >= phrase:
            self.phrases[: n - phrase + 1] = self._spans(phrase, n - phrase + 1) | np.uint64(1)
        self.least = self._least(self.phrases)

    def _spans(self, words: int, count: int) -> np.ndarray:
        return _mix((self.sums[words : words + count] - self.sums[:count]) * self.inverse[:count])

    def windows(self) -> np.ndarray:
        """The hash of the window from each word on; only where valid."""
        n = len(self.starts)
        out = np.zeros(n, np.uint64)
        if n >= self.window:
            out[: n - self.window + 1] = self._spans(self.window, n - self.window + 1)
        return out

    def _least(self, values: np.ndarray) -> np.ndarray:
        """The least of values over the phrases of the window from each word on."""
        span, width, out = self.window - self.phrase + 1, 1, values
        while 2 * width <= span:
            out = np.minimum(out, np.r_[out[width:], out[-1:].repeat(min(width, len(out)))])
            width *= 2
        rest = span - width
        return np.minimum(out, np.r_[out[rest:], out[-1:].repeat(min(rest, len(out)))]) if rest else out

    def chosen(self) -> np.ndarray:
        """Where a phrase stands that represents some window."""
        span, width = self.window - self.phrase + 1, 1
        out = np.where(self.valid, self.least, np.uint64(0))
        shift = lambda v, by: np.r_[np.zeros(min(by, len(v)), np.uint64), v[: max(0, len(v) - by)]]
        while 2 * width <= span:
            out = np.maximum(out, shift(out, width))
            width *= 2
        if span - width:
            out = np.maximum(out, shift(out, span - width))
        return np.flatnonzero((out == self.phrases) & (out > 0))

    def joined(self) -> tuple[str, np.ndarray]:
        """The words joined by one blank, blanks around, a character for each byte; and where after each word the next would begin."""
        raw = np.frombuffer(self.buffer, np.uint8)
        word = ~_BLANK[raw]
        keep = word | np.r_[False, word[:-1]]
        text = np.where(word, raw, 32)[keep].astype(np.uint8).tobytes().decode("latin-1")
        return " " + text, np.cumsum(self.ends - self.starts + 1) + 1

    def phrase_words(self, hashes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The hashes that phrases of these words have, and the words of one such phrase each, blanks around."""
        at = self.chosen()
        found, first = np.unique(self.phrases[at], return_index=True)
        here = np.isin(found, hashes)
        found, at = found[here], at[first[here]]
        text, after = self.joined()
        begin = np.r_[1, after[:-1]]
        spans = zip((begin[at] - 1).tolist(), after[at + self.phrase - 1].tolist(), strict=True)
        return found, [text[a:b].encode("latin-1") for a, b in spans]

    def located(self, shard: ahocorasick.Automaton) -> np.ndarray:
        """Windows whose representative phrase the automaton locates."""
        if shard.kind != ahocorasick.AHOCORASICK or not len(self.starts):
            return np.zeros(0, np.int64)
        text, after = self.joined()
        found = np.fromiter((end for end, _ in shard.iter(text)), np.int64)
        seen = np.zeros(len(self.starts), bool)
        seen[np.searchsorted(after, found + 1) - self.phrase + 1] = True
        values = np.where(seen, self.phrases, np.iinfo(np.uint64).max)
        return np.flatnonzero(self.valid & (self._least(values) == self.least))


def automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    """A shard that locates these phrases (words with blanks around) in joined words."""
    shard = ahocorasick.Automaton()
    for phrase in phrases:
        shard.add_word(phrase.decode("latin-1"), 1)
    shard.make_automaton()
    return shard


def _groups(texts: list[bytes]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > _BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def _cover(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window from one of starts on."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:n]) > 0


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("b"), F.col("text"))})


def repeated_passages(
    df: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, with_text: bool = True,
) -> DataFrame:
    """One row for each different text: t1, t2 (its key), n_words, n_removed, kept_sha256, and, if words go, kept_text
    (the words that stay, joined by one blank; only if with_text) and spans (first and last removed word of each
    stretch, from 0)."""
    keyed = _keyed(df, id_col, text_col)
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.col("t2"), F.lit(blocks)).cast("int")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            t1, t2 = (batch.column(i).to_pylist() for i in (1, 2))
            new = [i for i, k in enumerate(zip(t1, t2, strict=True)) if (seen.__setitem__(k, seen.get(k, 0) + 1) or seen[k] == 1)]
            texts = batch.column(0).take(pa.array(new, pa.int64())).cast(pa.large_binary()).to_pylist()
            for group in _groups(texts):
                words = Words([texts[i] for i in group], window, phrase)
                at = words.chosen()
                each = np.searchsorted(at, words.first)
                values = pa.array(words.phrases[at].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([t1[new[i]] for i in group]), pa.array([t2[new[i]] for i in group]), pa.array([1] * len(group), pa.int64()), lists], ["t1", "t2", "copies", "phrases"])
        again = [(k, n - 1) for k, n in seen.items() if n > 1]  # further copies in this task, as a number
        if again:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in again]), pa.array([k[1] for k, _ in again]), pa.array([n for _, n in again], pa.int64()), pa.nulls(len(again), pa.list_(pa.int64()))], ["t1", "t2", "copies", "phrases"])

    described = keyed.select("text", "t1", "t2").mapInArrow(describe, "t1 long, t2 long, copies long, phrases array<long>")
    texts = cut(described.groupBy("t1", "t2").agg(F.sum("copies").alias("copies"), F.first("phrases", ignorenulls=True).alias("phrases")), "texts")
    places = texts.select(block.alias("block"), F.explode("phrases").alias("phrase")).groupBy("phrase", "block").agg(F.count("*").alias("n"))
    places = cut(places, "places")
    recurring = places.groupBy("phrase").agg(F.sum("n").alias("n"), F.min("block").alias("block")).filter("n > 1").select("block", "phrase")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            yield batch.take(pa.array(new, pa.int64()))

    once_texts = keyed.select("text", "t1", "t2").mapInArrow(once, "text string, t1 long, t2 long").withColumn("block", block)
    dealt = bucketed(once_texts, "blocks", "block", max(shuffle_partitions(df.sparkSession), total >> 27))

    def unique(left: pa.Table) -> tuple[list[tuple], list[bytes]]:
        """The keys and texts of a block, each once."""
        keys = list(zip(left["t1"].to_pylist(), left["t2"].to_pylist(), strict=True))
        new = list(dict(zip(reversed(keys), reversed(range(len(keys))), strict=True)).values())
        return [keys[i] for i in new], left["text"].take(pa.array(new, pa.int64())).cast(pa.large_binary()).to_pylist()

    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[int, bytes] = {}
        if right.num_rows:
            texts, hashes = unique(left)[1], right["phrase"].to_numpy().view(np.uint64)
            for group in _groups(texts):
                found, spans = Words([texts[i] for i in group], window, phrase).phrase_words(hashes)
                rows |= zip(found.view(np.int64).tolist(), spans, strict=True)
        return pa.table([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["phrase", "words"])

    spelled = cut(dealt.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(extract, "phrase long, words binary"), "phrases")
    wanted = places.join(spelled, "phrase").select("block", "words")

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = unique(left)
        shard = automaton(right["words"].to_pylist())
        rows: dict[str, list] = {c: [] for c in ("t1", "t2", "n_words", "sha", "text", "starts", "keys", "marks")}
        for group in _groups(texts):
            words = Words([texts[i] for i in group], window, phrase)
            at = words.located(shard)
            each, hashes = np.searchsorted(at, words.first), words.windows()
            for j, i in enumerate(group):
                mine = at[each[j] : each[j + 1]]
                rows["t1"].append(keys[i][0])
                rows["t2"].append(keys[i][1])
                rows["n_words"].append(int(words.first[j + 1] - words.first[j]))
                rows["sha"].append(hashlib.sha256(b" ".join(texts[i].split())).hexdigest())
                rows["text"].append(texts[i].decode() if len(mine) else None)
                rows["starts"].append((mine - words.first[j]).astype(np.int32))
                rows["keys"].append(hashes[mine].view(np.int64))
                rows["marks"].append(words.least[mine].view(np.int64))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    located = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(locate, "t1 long, t2 long, n_words long, sha string, text string, starts array<int>, keys array<long>, marks array<long>")
    located = cut(located, "located")
    drop_cut(dealt, places, spelled)
    spots = located.filter(F.size("starts") > 0).select("t1", "t2", F.explode(F.arrays_zip("starts", "keys", "marks")).alias("w")).select("t1", "t2", F.col("w.starts").alias("start"), F.col("w.keys").alias("key"), F.col("w.marks").alias("mark"))
    confirmed = spots.groupBy("key", "mark").agg(F.count("*").alias("n")).filter("n > 1").select("key", "mark")
    confirmed = cut(confirmed, "confirmed")
    hits = cut(spots.join(confirmed, ["key", "mark"]).groupBy("t1", "t2").agg(F.collect_list("start").alias("hits")), "hits")
    counts = texts.select("t1", "t2", "copies")
    known = located.drop("starts", "keys", "marks").join(counts, ["t1", "t2"]).join(hits, ["t1", "t2"], "left")
    known = known.select("t1", "t2", "n_words", "sha", "copies", "text", "hits")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("n_removed", "kept_sha256", "kept_text", "spans")}
            cols = [batch.column(i).to_pylist() for i in (2, 3, 4, 5)]
            for n, sha, copies, text, hits in zip(*cols, batch.column(6), strict=True):
                if n < window or (copies < 2 and not hits.is_valid):
                    gone, sha, kept, spans = 0, sha, None, None
                elif copies > 1:
                    gone, sha, kept, spans = n, hashlib.sha256(b"").hexdigest(), "", [{"first": 0, "last": n - 1}]
                else:
                    cover = _cover(n, hits.values.to_numpy(), window)
                    words = text.encode().split()
                    kept_bytes = b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c])
                    edges = np.flatnonzero(np.diff(np.r_[False, cover, False]))
                    gone, sha, kept = int(cover.sum()), hashlib.sha256(kept_bytes).hexdigest(), kept_bytes.decode()
                    spans = [{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                for c, v in zip(rows.values(), (gone, sha, kept, spans), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], ["t1", "t2", "n_words", *rows])

    judged = known.mapInArrow(judge, "t1 long, t2 long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<first: long, last: long>>")
    passages = cut(judged if with_text else judged.drop("kept_text"), "passages")
    drop_cut(located, confirmed, hits, texts)
    return passages


def dedup_substrings(df: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of every document: each word is removed that is covered by a window
    of words which also starts anywhere else, in the same document or another.

    A null or empty text has no words; texts shorter than a window keep all; repeated rows are copies of each other,
    so they lose all their windows; null ids are kept as such; an empty table gives an empty one.
    """
    passages = repeated_passages(df, window, phrase, id_col, text_col, with_text=False, **options)
    rows = _keyed(df, id_col, text_col).select("id", "t1", "t2")
    return rows.join(passages, ["t1", "t2"]).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")
