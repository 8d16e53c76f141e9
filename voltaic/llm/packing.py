"""Best-fit packing of token sequences by hierarchical residual packing.

Each group of pieces is packed best-fit decreasing on its own; bins that are nearly full are final. The other bins
become items, are dealt to fewer groups and packed again, until one group holds them all or a group would grow over
its bound. A bin's contents never change, so a piece's place is the sum of its places along the tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm._common import cut

CAPACITY = 2048
#: Most words whose ids a worker remembers; results don't depend on it.
_CACHE = 1_500_000
_SPACES = str.maketrans("\n\t\r", "   ")


class WordIds:
    """Ids of whole texts by the tokenizers library, asked once for each new run of non-blank characters.

    Right for vocabularies that drop white space and never join tokens across it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bytes = np.zeros(len(self.ends), np.int64)  # of text that a token stands for, a character for each byte
        self.bytes[list(vocabulary.values())] = [len(t.removesuffix("</w>")) for t in vocabulary]
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Plain words, letters and perhaps one run of stops after them, go many to a call: each gives one pre-token, or
        two, whose last tokens are marked as ends in the vocabulary. Other words, and all if the ends or any word's
        bytes don't come out right, go one by one."""
        plain, sizes, alone = [], [], []
        for w in words:
            core = w.rstrip(".,;:!?")
            if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
                plain.append(w)
                sizes.append(1 + (len(core) < len(w)))
            else:
                alone.append(w)
        out: dict[str, bytes] = {}
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops, wanted = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(sizes[i : i + 512])
            spelled = np.cumsum([len(w.lower().encode()) for w in part])
            if len(stops) != wanted[-1] or (np.cumsum(self.bytes[ids])[stops[wanted - 1] - 1] != spelled).any():
                alone += part
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (stops[wanted - 1] * 4).tolist(), strict=True):
                out[w] = raw[at:end]
                at = end
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # str.split() also cuts at the separators 28 to 31, which are no white space to the tokenizer
        split = [t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else t.translate(_SPACES).split(" ") for t in texts]
        new = [w for w in set().union(*split) if w not in self.known]
        fresh = self._encode(new)
        self.known.update(fresh)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        full = len(self.known) > _CACHE  # then what came before stays known
        for w in fresh:
            if full or len(w) > 256:
                del self.known[w]
        return out


_by_path: dict[str, WordIds] = {}


def ids_of(path: str) -> WordIds:
    """One a Python worker: what it has learned serves its next tasks."""
    if path not in _by_path:
        _by_path[path] = WordIds(path)
    return _by_path[path]


def cut_pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) for every piece of every document: its ids and then the end id, cut
    after each capacity ids. A null text is the empty one: one piece holding the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_of(vocabulary)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, ids in enumerate(ids + last for k in range(0, len(texts), 128) for ids in words.ids(texts[k : k + 128])):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, k) for c, k in zip(rows[1:], kinds, strict=True))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.

    Open bins stand in one stack for each residual; a bit mask of the residuals in use gives the tightest in one step.
    """
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_residuals = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_residuals >> n
        if fits:
            residual = n + (fits & -fits).bit_length() - 1
            stack = stacks[residual]
            b = stack.pop()
            if not stack:
                open_residuals &= ~(1 << residual)
        else:
            residual, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - residual
        fill[b] += n
        if rest := residual - n:
            stacks[rest].append(b)
            open_residuals |= 1 << rest
    return bins, offsets, np.array(fill, np.int64)


def _pack_groups(items: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """items (item struct, length) dealt to groups at random, each packed on its own: with bin, fill and offset."""
    dealt = items.withColumn("g", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(groups)))

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        bins, offsets, fill = best_fit(part["length"].to_numpy(), capacity)
        # bins of different groups and levels never share a number
        number = (np.int64(level) << 56) | (np.int64(key[0].as_py()) << 32) | bins
        return part.drop_columns(["g"]).append_column("bin", pa.array(number, pa.int64())).append_column("bin_offset", pa.array(offsets, pa.int64())).append_column("fill", pa.array(fill[bins], pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.groupBy("g").applyInArrow(pack, f"{kinds}, bin long, bin_offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 4, group_items: int = 20_000, fan_in: int = 8) -> DataFrame:
    """pieces (with a length column from 1 to capacity) with sequence_id and offset: every piece once, no sequence over capacity.

    slack: bins with no more room than this are final at once. group_items: most items that one group is meant to
    hold; fan_in: by which the number of groups falls from round to round. Rounds end when one group holds all open
    bins, or when a round closed too few bins for the next to stay within group_items: what is open then is
    final, at most a few in a thousand bins more than one group would give. Rows may repeat; extra columns are kept
    (clashing names of the operator's own are replaced); an empty table gives an empty one.
    """
    own = ("sequence_id", "offset", "bin", "bin_offset", "fill", "key", "g", "to", "moved")
    base = pieces.drop(*own).withColumn("key", F.monotonically_increasing_id())
    base = cut(base, "pieces")  # the keys are fixed from here on
    n = base.count()
    groups = max(1, -(-n // group_items))
    placed = cut(_pack_groups(base, groups, 0, capacity), "packed0")
    level, maps = 1, []
    bins = placed.groupBy("bin").agg(F.first("fill").alias("length")).filter(F.col("length") < capacity - slack)
    while groups > 1:
        left = bins.count()
        fewer = max(1, -(-groups // fan_in), -(-left // group_items))
        if fewer >= groups and level > 1:
            break
        groups = fewer
        items = bins.select(F.col("bin").alias("key"), "length")
        moved = cut(_pack_groups(items, groups, level, capacity), f"packed{level}")
        maps.append(moved.select(F.col("key").alias("bin"), F.col("bin").alias("to"), F.col("bin_offset").alias("moved")))
        bins = moved.groupBy("bin").agg(F.first("fill").alias("length")).filter(F.col("length") < capacity - slack)
        level += 1
    for m in maps:
        placed = placed.join(m, "bin", "left").withColumns({"bin": F.coalesce("to", "bin"), "bin_offset": F.col("bin_offset") + F.coalesce("moved", F.lit(0))}).drop("to", "moved")
    return placed.withColumnsRenamed({"bin": "sequence_id", "bin_offset": "offset"}).drop("key", "fill")


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    packed = pack(cut_pieces(df, vocabulary, capacity, end, id_col, text_col), capacity, **options)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
